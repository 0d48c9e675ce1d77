import collections
import html
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from grainmill.llm import html_text as H
from grainmill.llm import line_dedup as L

SF = "/root/testdata/sf0.001"


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def own_units(text):
    """The rule of chunks, spelled out line by line: every span of lines that the definition names."""
    lines = text.split("\n")
    own = [k for k, x in enumerate(lines) if x.encode().split()]
    pair = lambda j: ((xxhash.xxh64_intdigest(lines[own[j]].encode(), 7) * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(lines[own[j + 1]].encode(), 7)) % 2**64) // 2**32
    pairs = [pair(j) for j in range(len(own) - 1)]
    cut = [p % 2 == 0 or p in pairs[max(0, j - 32) : j] for j, p in enumerate(pairs)]
    long = [len(lines[k].encode().split()) >= 8 for k in own]
    starts = [long[j] or j < len(cut) and cut[j] for j in range(len(own))]
    ends = [long[j] or j > 0 and cut[j - 1] for j in range(len(own))]
    spans = {(j, j) for j, k in enumerate(own) if len(lines[k].encode().split()) >= 50}
    for j in range(len(own)):
        spans |= {(j, e) for e in [next((e for e in range(j + 1, len(own)) if ends[e]), None)] if e is not None}
        spans |= {(s, j) for s in [next((s for s in range(j - 1, -1, -1) if starts[s]), None)] if s is not None}
    return {(own[a], own[b] - own[a] + 1) for a, b in spans}


def brute(rows):
    """Every unit but the first of equal bytes goes."""
    places, known = collections.defaultdict(set), {}
    for i, t in rows:
        if t is not None:
            lines = t.encode().split(b"\n")
            known[t] = own_units(t)
            for a, n in known[t]:
                places[b"\n".join(lines[a : a + n]), n].add((i is not None, i or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), a))
    first, out = {k: min(v) for k, v in places.items()}, []
    for i, t in rows:
        gone = set()
        lines = (t or "").split("\n")
        for a, n in known.get(t, ()):
            at = (i is not None, i or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), a)
            if first["\n".join(lines[a : a + n]).encode(), n] != at:
                gone |= set(range(a, a + n))
        out.append(Row(doc_id=i, text=None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), n_lines=len(lines) if t is not None else 0, n_removed=len(gone)))
    return sorted(map(str, out))


def test_lines_equal_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(10_000 + k, "\n".join([f"own line {k}", *(f"shared line {j} of a passage" for j in range(12)), f"own end {k}"])) for k in range(5)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(str, got.collect())) == brute(rows)


def test_shared_passages_go_and_one_stays(spark):
    passage = [f"shared line {j} of a long passage" for j in range(30)]
    rows = [(k, "\n".join([*(f"own {k} {j}" for j in range(k)), *passage, f"end {k}"])) for k in range(6)]
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0].n_removed == 0 and all(out[k].n_removed >= 15 for k in range(1, 6))
    assert all(f"own {k} {j}" in out[k].text for k in range(6) for j in range(k))


def test_long_line_is_a_passage(spark):
    line = " ".join(f"word{j}" for j in range(60))
    out = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame([(2, f"a\n{line}\nb"), (1, f"c\n{line}")], "doc_id bigint, text string")).collect()}
    assert out == {1: f"c\n{line}", 2: "a\nb"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9])
def test_short_passages_go_whole(spark, n):
    """Every line of a passage of over 50 words goes from all copies but the first, wherever chunks end."""
    passages = [[" ".join(f"p{p}l{j}w{w}" for w in range(51 // n + 1 + j % 2)) for j in range(n)] for p in range(12)]
    rows = [(100 * c + p, "\n".join([f"own {c} {p}", *x, f"end {c} {p}"])) for c in range(3) for p, x in enumerate(passages)]
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(out[i].text == (t if i < 100 else f"own {i // 100} {i % 100}\nend {i // 100} {i % 100}") for i, t in rows)


@pytest.mark.parametrize("n", [8, 12, 30])
def test_recall_of_passages_of_short_lines(spark, n):
    """Of passages of n lines of three words amid own lines, nine tenths of all lines at least go from the second document."""
    random.seed(n)
    passages = [[f"p{p} l{j} {random.random()}" for j in range(n)] for p in range(300)]
    rows = [(1000 * c + p, "\n".join([*(f"own {random.random()}" for _ in range(random.randrange(1, 9))), *x, f"end {random.random()}"])) for c in range(2) for p, x in enumerate(passages)]
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(out[1000 + p].n_removed for p in range(300)) >= 0.9 * 300 * n and not any(out[p].n_removed for p in range(300))
    assert all("own" not in x for i, t in rows for x in set(t.split("\n")) - set(out[i].text.split("\n")))


def test_anchors_move_with_content():
    random.seed(5)
    lines = [f"line {random.random()}".encode() for _ in range(300)]
    at = lambda x: {(x[a], x[b]) for a, b in L.chunks(x)}
    assert len(at(lines) ^ at([b"new", *lines])) < 8
    assert {k for a, b in L.chunks(lines) for k in range(a, b + 1)} == set(range(300)) and all(b > a for a, b in L.chunks(lines))


@pytest.mark.parametrize("lines", [["x"] * 100_000, ["a", "b", "c", "d", "e"] * 20_000, ["x", ""] * 50_000, [""] * 100_000])
def test_periodic_lines_make_no_long_chunks(lines):
    found = L.units("\n".join(lines))
    assert len(found) <= 2 * len(lines) and max((n for _, n, _ in found), default=0) <= 64


def test_lines_of_odd_tables(none, clash):
    assert L.dedup_lines(none).count() == 0
    assert L.dedup_lines(clash).count() == clash.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><main><h1>Head  &amp; line</h1><p>First <b>bo</b>ld<br>text<p>second</p><ul><li>one<li>two</ul><form>mail<input></form>
<div class="ad">Buy</div><table><tr><td>c1<td>c2</table><section id="comments"><article class="comment">Nice</article></section><p hidden>no</main><aside>side</aside><footer>foot</footer><script>if (a < b) "</p>"</script>"""


def test_structure():
    page = H.blocks(PAGE)
    assert " ".join(t for p, t in page if p == H.ARTICLE) == "Head & line First bold text second one two c1 c2 no"
    assert not [t for p, t in page if p == H.BODY] and "Nice" in [t for p, t in page if p == H.PAGE_CHROME]


@pytest.mark.parametrize("text", [None, "", "<", "<p", "</div>", "<!-- open", "<script>x", "a &lt b", "<div " + "x" * 1000])
def test_broken_markup(text):
    assert isinstance(H.blocks(text), list)


def test_articles_equal_brute_force(spark):
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    want = {}
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", p))).strip() for p in re.split("</?(?:p|h1)>|<br>", inner))
        want[r["page_id"]] = " ".join(p for p in parts if p)
    got = H.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def said(name, n):
    return " ".join(f"{name}x{j}" for j in range(n))


def rows_of(spark, rows, **options):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r for r in H.extract(frame, **options).collect()}


def test_ranks_are_those_of_prefixes():
    random.seed(3)
    tokens = np.array([random.randrange(3) for _ in range(400)], np.uint64)
    for depth in (1, 2, 8, 32):
        found, want = collections.defaultdict(set), collections.defaultdict(set)
        assert depth < 4 or np.array_equal(H.ranks(tokens, depth), H.ranks(H.ranks(tokens, 4), depth, 4))
        for k, r in enumerate(H.ranks(tokens, depth).tolist()):
            found[r].add(k)
        for k in range(len(tokens) - depth + 1):
            want[tuple(tokens[k : k + depth].tolist())].add(k)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert not len(H.ranks(tokens[:5], 8))


def test_pages_with_a_run_in_common_pick_a_suffix_in_common():
    random.seed(4)
    for _ in range(100):
        run = [random.getrandbits(60) for _ in range(H.SHORT + H.STRIDE - 1)]
        picked = []
        for _ in range(2):
            before, after = ([random.getrandbits(60) for _ in range(random.randrange(60))] for _ in range(2))
            rank = H.ranks(np.array(before + run + after, np.uint64), H.SHORT)
            at = H.minimisers(rank)
            assert np.diff(at).max(initial=0) <= H.STRIDE
            picked.append({k - len(before) for k in at.tolist() if len(before) <= k <= len(before) + H.STRIDE - 1})
        assert picked[0] & picked[1]


def test_thinned_rows_keep_the_counts():
    random.seed(5)
    keys, contents = (np.array([random.randrange(n) for _ in range(2000)]) for n in (40, 9))
    k, c, n = H.thinned(keys, contents)
    for key in range(40):
        own = k == key
        assert n[own].sum() == (keys == key).sum() and len(set(c[own])) == own.sum() == min(H.ROWS_A_RANK, len(set(contents[keys == key])))


def test_repeats_decide_inside_articles(spark):
    """An advert on all pages of a host, and a notice on three of them, go from articles without any class name; so do parts of text; a quotation on two pages stays."""
    article = lambda k, *more: f"<body><article><p>{said(f'own{k}', 60)}</p>{''.join(f'<div>{m}</div>' for m in more)}<p>{said(f'end{k}', 30)}</p></article>"
    advert, notice, quote, run = said("advert", 12), said("notice", 40), said("quote", 40), said("run", H.LONG + H.SHORT + H.STRIDE)
    more = {k: [advert] + [notice] * (k < 3) + [quote] * (k in (7, 8)) + [f"{said(f'in{k}', 5)} {run}"] * (20 <= k < 23) for k in range(50)}
    rows = [(k, f"http://h.org/{k}", article(k, *m)) for k, m in more.items()]
    out, plain = rows_of(spark, rows), rows_of(spark, rows, coverage=False)
    for k in range(50):
        assert plain[k].text == " ".join([said(f"own{k}", 60), *more[k], said(f"end{k}", 30)])
        assert out[k].text == " ".join([said(f"own{k}", 60), *([quote] if k in (7, 8) else []), said(f"end{k}", 30)])
        assert out[k].n_covered == out[k].n_removed == len(more[k]) - (k in (7, 8))


def test_near_copies_of_an_article_stay(spark):
    rows = [(k, f"http://h.org/{k}", f"<article><p>{said('same', 80)}</p><p>{said('more', 50)}</p><p>{said(f'own{k}', 9)}</p></article>") for k in range(4)]
    rows += [(10 + k, f"http://h.org/o/{k}", f"<article>{said(f'other{k}', 50)}</article>") for k in range(6)]
    assert rows_of(spark, rows) == rows_of(spark, rows, coverage=False) | {k: r for k, r in rows_of(spark, rows).items() if r.n_covered}
    assert all(r.text.startswith("samex0 ") and r.text.endswith("x8") for k, r in rows_of(spark, rows).items() if k < 10)


def test_a_block_on_three_of_very_many_pages(spark):
    """The answer doesn't depend on the host's size or on how pages are dealt; the join beyond the broadcast bound gives the same rows."""
    block = said("notice", 40)
    rows = [(k, f"http://h.org/{k}", f"<article><p>{said(f'own{k}', 40)}</p>{f'<div>{block}</div>' if k % 1700 == 3 else ''}<p>{said(f'end{k}', 12)}</p></article>") for k in range(5000)]
    rows += [(9000, "http://other.org/", rows[3][2])]
    out = rows_of(spark, rows)
    assert all(out[k].text == f"{said(f'own{k}', 40)} {said(f'end{k}', 12)}" for k in range(5000)) and block in out[9000].text
    assert out == rows_of(spark, rows, broadcast_bytes=0)


def test_random_pages_against_brute_force(spark):
    """Without an article: whole blocks on two distinct pages go, blocks in which no run of SHORT tokens is repeated stay."""
    random.seed(2)
    pool = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 30))) for _ in range(60)]
    pages = [[random.choice(pool) if random.random() < 0.5 else said(f"u{k}u{j}", random.randrange(1, 25)) for j in range(random.randrange(1, 8))] for k in range(60)]
    distinct = {tuple(p) for p in pages}
    wholes, windows = collections.defaultdict(set), collections.defaultdict(set)
    for p in distinct:
        flat = " ".join(p).split()
        for b in p:
            wholes[b].add(p)
        for j in range(len(flat) - H.SHORT + 1):
            windows[tuple(flat[j : j + H.SHORT])].add(p)
    rows = [(k, f"http://h.org/{k}", "<body>" + "".join(f"<div>{b}</div>" for b in p)) for k, p in enumerate(pages)]
    for k, r in rows_of(spark, rows).items():
        p, flat, at, kept, must, may = pages[k], " ".join(pages[k]).split(), 0, [], [], []
        for b in p:
            n = len(b.split())
            hit = {j for s in range(len(flat) - H.SHORT + 1) if len(windows[tuple(flat[s : s + H.SHORT])]) > 1 for j in range(s, s + H.SHORT)}
            must.append(n >= H.SHORT and len(wholes[b]) > 1)
            may.append(bool(hit & set(range(at, at + n))) or must[-1])
            at += n
        kept = [b for b, m in zip(p, may, strict=True) if not m]
        own = r.text.split()
        assert r.n_covered >= sum(must) and r.n_covered <= sum(may)
        if r.n_covered < len(p):
            assert all(b.split()[0] in own for b in kept) and len(p) - r.n_removed == len(p) - r.n_covered


HOSTILE = ['<p a="' + "x<b " * 250_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<ul>" + "<li><span>" * 50_000, "</script" * 100_000, "<a b='<a b=\"" * 80_000, "&#" + "9" * 1_000_000 + ";", "<p>" + "<b>" * 100_000 + "x", "<!--" * 200_000]


@pytest.mark.parametrize("html", HOSTILE)
def test_long_hostile_pages_are_parsed_in_linear_time(html):
    began = time.process_time()
    H.Page(html, "h.org")
    assert time.process_time() - began < 5


def test_references_with_many_digits():
    assert H.decoded("&#0000000065; &#" + "9" * 5000 + "; &#x" + "F" * 5000 + ";&lt &amp;amp;") == "A � �< &amp;"


@pytest.mark.parametrize("inside", ['<div class="related work">real</div>', "<label>real</label>", "<math><mi>real</mi></math>", "<noscript>real</noscript>", "<p hidden>real</p>", '<p class="share promo">real</p>'])
def test_what_the_contract_does_not_list_stays(inside):
    assert [t for p, t in H.blocks(f"<article>a{inside}</article>") if p == H.ARTICLE] in (["a", "real"], ["areal"])


def test_page_without_article_keeps_unique_runs(spark):
    menu = "<div>all about the site and everything else that stands on it</div>"
    rows = [(k, f"http://h.org/{k}", f"<body>{menu}<p>text {' '.join(f'w{k}x{j}' for j in range(20))}</p></body>") for k in range(3)]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(t.startswith("text w") and "site" not in t for t in out.values())


def test_pairs_of_blocks_on_a_host(spark):
    """A block on two pages of a host goes from pages without an article; copies of a page are one page."""
    text = {k: " ".join(f"note{k // 2}x{j}" for j in range(12)) for k in range(40)}
    rows = [(k, f"http://h.org/{k}", f"<body><p>{text[k]}</p><p>{' '.join(f'w{k}x{j}' for j in range(20))}</p></body>") for k in text]
    rows += [(100 + k, f"http://h.org/copy/{k}", f"<body><p>{' '.join(f'c{j}' for j in range(30))}</p></body>") for k in range(10)]
    rows += [(200, "http://other.org/", rows[0][2])]
    out = rows_of(spark, rows)
    assert out == rows_of(spark, rows, broadcast_bytes=0)
    assert all(out[k].n_covered == 1 and "note" not in out[k].text for k in text) and all(out[100 + k].n_covered == 0 for k in range(10)) and "note" in out[200].text


def test_copied_pages_keep_their_text(spark):
    text = "<body><p>" + " ".join(f"w{j}" for j in range(30)) + "</p><p>" + " ".join(f"v{j}" for j in range(30))
    out = H.extract(spark.createDataFrame([(k, "http://h.org/", text) for k in range(4)], "page_id bigint, url string, html string"))
    assert {r.n_chars for r in out.collect()} == {len(" ".join([f"w{j}" for j in range(30)] + [f"v{j}" for j in range(30)]))}


def test_pages_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "x", "<p>a", 2), (1, "http://a/", "", 3)], "page_id bigint, url string, html string, g int")
    assert sorted((r.text, r.n_chars) for r in H.extract(df).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert H.extract(df.limit(0)).count() == 0
    rows = [(1, "http://a/", "<p>a</p>"), (1, "http://a/", "<p>a</p>"), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    clash = frame.select("*", *(F.lit(1).alias(c) for c in ("i", "t", "u", "k", "n", "c", "p", "host", "own", "text", "ks", "a.b")))
    for options in ({}, {"broadcast_bytes": 0}):
        assert sorted(map(str, H.extract(clash, **options).collect())) == sorted(map(str, H.extract(frame, **options).collect()))
