"""Main text of HTML pages, with a suffix array for each host.

Each page becomes a list of blocks in page order, each with a place: ``article`` (inside article, main or role=main),
``chrome`` (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments: by element, role, class
or id) or ``body`` (the rest). Scripts, styles, templates, comments and the head never become blocks. A page's main blocks are
its article blocks or, if it has none, its body blocks. Parsing takes time linear in the page's length.

The main blocks' tokens of all pages of a host form one string, of which a sparse suffix array is built: suffixes start at
block starts and at minimisers, the smallest of STRIDE neighbouring SHORT-token prefixes, so that pages that share a
run pick the same ones. The rank of a suffix is that of its first SHORT or LONG tokens, from prefix doubling; ranks are 64-bit
hashes (of the host too), so that they agree between machines and no host needs to fit into one. Putting equal ranks together is a
shuffle by rank. It counts the distinct pages (copies of a page, equal in all main blocks, are one) and all pages on which the
substring stands; before it, a batch sends three rows a rank at most, so that a hot one stays small.

A token is covered if it lies in a repeated substring, or between two neighbouring suffixes that both begin with one. Repeated means, on a page
without an article: SHORT tokens, or a whole block, on two distinct pages. In an article, where pages quote each other and copies are main text too:
LONG tokens, or a whole block of as many, on three distinct pages; or a whole block of SHORT tokens or more on three distinct pages and
at least half the pages of the host. A block with half its tokens or more covered is boilerplate. The text is
the unique runs: the main blocks without boilerplate. All of it stays if every main block is boilerplate; and an article more than
half of which is boilerplate by LONG substrings alone is a copy and stays whole.

Runs of LONG + SHORT + STRIDE tokens in articles and of SHORT + STRIDE - 1 elsewhere always hold a common suffix; blocks always start one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import field, partitions, session, written
from grainmill.llm.url_rules import host_of

SHORT, LONG, STRIDE, BROADCAST_BYTES = 8, 32, 25, 32 << 20
#: Rows that a batch sends for one rank at most.
ROWS_A_RANK = 3
_TAIL = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|svg|canvas|select|textarea|title)(?=[\s/>]){_TAIL}(?:>|\Z).*?(?=</\1[\s/>]|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+){_TAIL}(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(role|class|id)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
#: Elements that end a block; the others stand inside a line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu dialog button fieldset input search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids: menus, footers, sidebars, notices, adverts, reader comments.
NAMES = frozenset("menu menus nav navbar navigation breadcrumb breadcrumbs footer sidebar sidebars notice notices cookie cookies consent gdpr ad ads advert adverts advertisement advertising sponsor sponsored sponsors comment comments commentlist disqus".split())
COMMENTS = frozenset("comment comments commentlist disqus ad ads advert advertisement sponsored".split())
#: Page headers, outside an article.
HEADERS = frozenset("header masthead".split())
#: Start tags that end an open paragraph or item only up to these.
_P_STOPS, _LI_STOPS, _DL_STOPS = ("article", "div", "section", "td", "li", "blockquote"), ("ul", "ol", "menu"), ("dl",)
_ITEMS = frozenset("li dd dt td th tr option".split())
#: Names that say nothing by themselves.
_PLAIN = frozenset("a b i p h1 h2 h3 h4 h5 h6 em strong span div ul ol li td tr table tbody section html body".split())
_WORDS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
ARTICLE, BODY, PAGE_CHROME = 0, 1, 2
#: What a rank counts: pages of the host, whole article blocks, LONG tokens of an article, tokens or blocks of a page without one.
PAGES, WHOLE, RUN, LOOSE = range(4)
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _is_chrome(tag: str, raw: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the element is chrome; whether it is a main container."""
    if not raw and tag in _PLAIN:
        return False, False
    attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(raw)} if raw else {}
    role = attributes.get("role", "")
    main = tag in ("article", "main") or role in ("main", "article")
    names = []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        found = _WORDS.findall(name)
        if not {"has", "with", "no", "without"} & set(found):
            names += found
    if tag in ("html", "body"):
        return False, False
    if main:
        return bool(COMMENTS.intersection(names)), True
    if tag in CHROME or role in ROLES:
        return True, False
    if not in_article and (tag == "header" or HEADERS.intersection(names)):
        return True, False
    return bool(NAMES.intersection(names)), False


def _number(m: re.Match) -> str:
    """A reference with very many digits, of which the library's own function would raise an error."""
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return f"&#{'' if m[1] else 'x'}{digits};" if len(digits) < 8 else "�"


def decoded(text: str) -> str:
    """Character references decoded, white space turned into one space, trimmed."""
    if "&" in text:
        text = unescape(_NUMBER.sub(_number, text))
    return " ".join(text.split())


class _Open:
    """The open elements, with the places of each name, so that no step looks through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = [("", False, False)]
        self.places: dict[str, list[int]] = {}
        self.block_places = [0]

    def push(self, tag: str, chrome: bool, article: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, chrome, article))

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        found = 0
        for tag in tags:
            own = self.places.get(tag)
            if own and own[-1] > found:
                found = own[-1]
        return found

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(place, text) of every block with text, in page order; white space inside is one space."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    opened = _Open()
    stack, at, html = opened.stack, 0, html or ""

    def flush() -> None:
        if held:
            text = decoded("".join(held))
            held.clear()
            if text:
                _, chrome, article = stack[-1]
                out.append((PAGE_CHROME if chrome else ARTICLE if article else BODY, text))

    def close(tag: str, stops: tuple[str, ...]) -> None:
        own = opened.places.get(tag)
        if own and (own[-1] == len(stack) - 1 or own[-1] > opened.last(*stops)):
            leave(own[-1])

    def leave(k: int) -> None:
        if stack[-1][1:] != stack[k - 1][1:]:
            flush()
        opened.cut(k)

    for m in _MARKUP.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m[4]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m[3]:
            own = opened.places.get(tag)
            # an inline end tag never closes a block
            if own and (block or own[-1] > opened.block_places[-1]):
                leave(own[-1])
            continue
        if block:
            if tag not in _ITEMS or stack[-1][0] == "p":
                close("p", _P_STOPS)
            if tag == "li":
                close("li", _LI_STOPS)
            elif tag in ("dd", "dt"):
                close("dd", _DL_STOPS)
                close("dt", _DL_STOPS)
        if tag in VOID:
            continue
        _, chrome, article = stack[-1]
        own, main = _is_chrome(tag, m[5], article)
        if own and not chrome or main and not article:
            flush()
        if not m[5].rstrip().endswith("/") or block:
            opened.push(tag, chrome or own, article or main)
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def ranks(tokens: np.ndarray, depth: int, length: int = 1) -> np.ndarray:
    """By prefix doubling, from ranks of ``length`` tokens: a hash of the ``depth`` tokens from each place on that has as many; depth is ``length`` times a power of two."""
    while length < depth:
        tokens = _mixed(tokens[:-length] * _MIX + tokens[length:]) if len(tokens) > length else tokens[:0]
        length *= 2
    return tokens


def minimisers(rank: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Places of the smallest of each ``stride`` neighbouring ranks, in order; of all, if there are fewer."""
    if len(rank) <= stride:
        return np.array([rank.argmin()]) if len(rank) else np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(rank, stride).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


class Page:
    """A page's blocks, and the sampled suffixes of its main ones."""

    def __init__(self, html: str | None, host: str | None):
        self.blocks = blocks(html)
        self.article = any(p == ARTICLE for p, _ in self.blocks)
        own = ARTICLE if self.article else BODY
        self.main = [t for p, t in self.blocks if p == own]
        parts = [t.split() for t in self.main]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        seed = xxhash.xxh64_intdigest(host or "", 5)
        digest = xxhash.xxh64_intdigest
        tokens = np.array([digest(t, 3) for p in parts for t in p], np.uint64)
        short = ranks(tokens, SHORT)
        at = minimisers(short)
        if self.article:
            deep = ranks(short, LONG, SHORT)
            self.at, self.depth, kind = at[at < len(deep)], LONG, RUN
            found = deep[self.at]
        else:
            first = self.starts[self.starts < len(short)]
            self.at, self.depth, kind = np.union1d(at, first), SHORT, LOOSE
            found = short[self.at]
        self.whole = np.flatnonzero(self.sizes >= SHORT)
        texts = np.array([digest(self.main[k], 7) for k in self.whole], np.uint64)
        self.suffix_keys = self._keys(found + np.uint64(seed), kind)
        self.block_keys = self._keys(texts ^ np.uint64(seed), WHOLE if self.article else LOOSE)
        self.host_key = self._keys(np.array([seed], np.uint64), PAGES)
        self.content = xxhash.xxh32_intdigest("\0".join(self.main), 9) - (1 << 31)

    @staticmethod
    def _keys(values: np.ndarray, kind: int) -> np.ndarray:
        return (_mixed(values) & ~np.uint64(3) | np.uint64(kind)).view(np.int64)

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate([self.suffix_keys, self.block_keys, self.host_key]))

    def text(self, told: Told | None) -> tuple[str, int, int]:
        """The text, main blocks that are boilerplate, blocks that don't stand in the text."""
        if told is None or not len(self.main):
            return " ".join(self.main), 0, len(self.blocks) - len(self.main)
        total = int(self.sizes.sum())
        hits, whole = told.pages(self.suffix_keys) > 0, told.pages(self.block_keys)
        edge = np.zeros(total + LONG + 1, np.int64)
        at = self.at[hits]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.depth, -1)
        both = np.flatnonzero(hits[1:] & hits[:-1])
        np.add.at(edge, self.at[both], 1)
        np.add.at(edge, self.at[both + 1], -1)
        marked = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:total] > 0)])
        covered = 2 * (marked[self.starts + self.sizes] - marked[self.starts]) >= self.sizes
        site = np.zeros(len(self.main), bool)
        if self.article:
            everywhere = max(1, int(told.pages(self.host_key)[0]))
            site[self.whole] = 2 * whole >= everywhere
            covered[self.whole] |= (whole > 0) & (self.sizes[self.whole] >= LONG)
            if 2 * int(self.sizes[covered & ~site].sum()) > total:
                covered[:] = False
        else:
            site[self.whole] = whole > 0
        covered |= site
        covered &= self.sizes > 0
        gone = covered if not covered.all() else np.zeros(len(covered), bool)
        return " ".join(t for t, g in zip(self.main, gone.tolist(), strict=True) if not g), int(covered.sum()), len(self.blocks) - len(self.main) + int(gone.sum())


class Told:
    """Ranks, sorted, and the pages of each."""

    def __init__(self, ranked: np.ndarray, pages: np.ndarray):
        order = np.argsort(ranked)
        self.ranks, self.counts = ranked[order], pages[order]

    def pages(self, keys: np.ndarray) -> np.ndarray:
        """For each key the pages that have it; 0 if it isn't repeated."""
        if not len(self.ranks):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.ranks, keys), len(self.ranks) - 1)
        return np.where(self.ranks[at] == keys, self.counts[at], 0)


def thinned(keys: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, content, pages): at most ROWS_A_RANK rows a key, of distinct contents, whose pages add up to all rows of the key."""
    order = np.lexsort((contents, keys))
    keys, contents = keys[order], contents[order]
    if not len(keys):
        return keys, contents, np.empty(0, np.int64)
    new_key = np.r_[True, keys[1:] != keys[:-1]]
    first = np.flatnonzero(new_key | np.r_[True, contents[1:] != contents[:-1]])
    pages, key_of = np.diff(np.r_[first, len(keys)]), np.cumsum(new_key[first]) - 1
    head = np.flatnonzero(new_key[first])
    place = np.arange(len(first)) - head[key_of]
    beyond = place >= ROWS_A_RANK
    np.add.at(pages, head[key_of[beyond]], pages[beyond])
    first, pages = first[~beyond], pages[~beyond]
    return keys[first], contents[first], pages


def repeated(rows: DataFrame) -> DataFrame:
    """(t, host) to (k, n): the keys that stand on as many distinct pages as their kind asks for, and the pages of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contents = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for t, host in zip(batch.column(0), batch.column(1), strict=True):
                page = Page(t.as_py(), host.as_py())
                keys.append(page.keys())
                contents.append(np.full(len(keys[-1]), page.content, np.int64))
            k, c, n = thinned(np.concatenate(keys), np.concatenate(contents))
            yield pa.record_batch([pa.array(k), pa.array(c, pa.int32()), pa.array(n, pa.int32())], names=["k", "c", "n"])

    found = rows.select("t", "host").mapInArrow(run, "k bigint, c int, n int").repartition(partitions(session(rows)), "k")
    found = found.groupBy("k", "c").agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"))
    kind = F.col("k").bitwiseAND(3)
    return found.where((kind == PAGES) & (F.col("distinct") >= 3) | (kind == LOOSE) & (F.col("distinct") >= 2) | kind.isin(WHOLE, RUN) & (F.col("distinct") >= 3)).select("k", "n")


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", broadcast_bytes: int = BROADCAST_BYTES, coverage: bool = True) -> DataFrame:
    """Per row: the id, url, text, n_chars (code points), n_blocks, n_covered and n_removed.

    Null and empty html give an empty text. A null url, or one without ://, counts to a host without a name. Copies of a page
    are pages of their own. Very long pages take memory in proportion to the page. An empty table gives an empty one; other
    columns, whatever their names, are left out. Of ties there are none: every page is judged by counts.

    The repeated ranks go to all tasks while they take up to ``broadcast_bytes``, so that no text is moved. Beyond that each page
    gets its own ones by a join. Both give the same rows. ``coverage`` False leaves out the suffix array.
    """
    spark = session(pages)
    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(field(pages, id_column).alias("i"), field(pages, url_column).cast("string").alias("u"), field(pages, html_column).cast("string").alias("t"))
    rows = rows.withColumn("host", host_of(F.col("u")))
    shared = told = None
    if coverage:
        told = written(repeated(rows), "repeated-substrings")
        if 16 * told.count() <= broadcast_bytes:
            found = told.toArrow()
            shared = spark.sparkContext.broadcast(Told(found["k"].to_numpy(), found["n"].to_numpy()))
            told = None

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], []
            for j, (t, host) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                page = Page(t.as_py(), host.as_py())
                own = shared.value if shared else None
                if batch.num_columns > 4:
                    own = Told(*(batch.column(c)[j].values.to_numpy() if batch.column(c)[j].is_valid else np.empty(0, np.int64) for c in (4, 5)))
                text, n_covered, removed = page.text(own)
                texts.append(text)
                numbers.append((len(text), len(page.blocks), n_covered, removed))
            columns = [pa.array(x, pa.int64()) for x in (zip(*numbers, strict=True) if numbers else [()] * 4)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *columns], names=["i", "u", "text", "n_chars", "n_blocks", "n_covered", "n_removed"])

    if told is not None:

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [Page(t.as_py(), host.as_py()).keys() for t, host in zip(batch.column(0), batch.column(1), strict=True)]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.record_batch([batch.column(2).take(at), pa.array(np.concatenate([np.empty(0, np.int64), *keys]))], names=["p", "k"])

        # copies of a page, with the same host, share their list
        rows = rows.withColumn("p", F.xxhash64("host", "t"))
        wanted = rows.select("t", "host", "p").mapInArrow(listed, "p bigint, k bigint").join(told, "k").distinct()
        wanted = wanted.groupBy("p").agg(F.collect_list(F.struct("k", "n")).alias("own"))
        rows = rows.join(wanted, "p", "left").select("i", "u", "t", "host", F.col("own.k").alias("ks"), F.col("own.n").alias("ns"))
    out = rows.mapInArrow(judged, f"i {kind}, u string, text string, n_chars bigint, n_blocks bigint, n_covered bigint, n_removed bigint")
    return out.withColumnsRenamed({"i": id_column, "u": url_column})
