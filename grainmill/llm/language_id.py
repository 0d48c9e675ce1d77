"""Language identification by the nearest of several centroids per language.

A text becomes the vector of its byte 2-grams and 3-grams (lower-cased; ASCII other than letters as spaces), hashed
into DIMENSIONS counts, log-scaled, weighted by inverse document frequency and normalised. The classifier is fitted on a sample of
labelled rows of bounded size, the only bound here: at most ``sample`` rows in all, and as many of each
language as of any other, the ones with the smallest MD5 of their id and text. Each language's vectors are clustered by spherical
k-means from k-means++ seeds; a cluster with less than SHARE of its language's rows goes and its rows join the others, and so does a cluster in
which another language prevails. Prediction covers whole texts of all rows: the language of the centroid with the largest cosine, the first by
(language, number) of equal ones; the cosine is the score.

Rejection is by distance, which depends on a text's length: a radius is fitted for each language and octave of n-gram counts. It is the
QUANTILE of the cosine distances of the members, which are the sample's texts and a piece of each, of 10 to 1280 bytes, that are nearest to a centroid of their own language;
widened by SLACK of what is left to distance 1. An octave with fewer than MEMBERS of them takes the distances of all languages, and no radius
is smaller than that of longer texts. A text farther than that from its nearest centroid is rejected, and so is one without a letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import field, kept_rows, map_rows, session

DIMENSIONS, BITS = 4096, 12
SAMPLE, CLUSTERS, SHARE = 2000, 4, 0.05
QUANTILE, SLACK, MEMBERS, OCTAVES = 0.99, 0.25, 15, 24
#: Bytes of the pieces that tell how far short texts lie.
PIECES = (10, 20, 40, 80, 160, 320, 640, 1280)
#: Bytes of text turned into counts at a time.
SEGMENT = 4 << 20
_LETTER = regex.compile(r"\p{L}")
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_BLANK = 0x202020


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _slots(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last positions and hashed slots of the 2-grams and 3-grams; all-blank ones are left out."""
    wide = data.astype(np.uint32)
    two = wide[:-1] << 8 | wide[1:]
    three = two[:-1] << 8 | wide[2:]
    at2, at3 = np.flatnonzero(two != _BLANK & 0xFFFF), np.flatnonzero(three != _BLANK)
    values = np.concatenate([two[at2] | np.uint32(1 << 24), three[at3]])
    return np.concatenate([at2, at3]), np.concatenate([at2 + 1, at3 + 2]), (values * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def counts(texts: list[str]) -> np.ndarray:
    """A row of n-gram counts for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    raw = [b" " + t.lower().encode().translate(_SPACED) + b" " for t in texts]
    group: list[int] = []

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(raw[k] for k in group), np.uint8)
        first, last, slots = _slots(data)
        text_of = np.repeat(np.arange(len(group)), [len(raw[k]) for k in group])
        owner = text_of[first]
        whole = owner == text_of[last]
        out[group] += np.bincount(owner[whole] * DIMENSIONS + slots[whole], minlength=len(group) * DIMENSIONS).reshape(len(group), DIMENSIONS)
        group.clear()

    held = 0
    for k, r in enumerate(raw):
        if len(r) > SEGMENT:
            for i in range(0, len(r) - 2, SEGMENT):
                slots = _slots(np.frombuffer(r[i : i + SEGMENT + 2], np.uint8))[2]
                out[k] += np.bincount(slots, minlength=DIMENSIONS)
            continue
        if held + len(r) > SEGMENT or len(group) >= 128:
            flush()
            held = 0
        group.append(k)
        held += len(r)
    flush()
    return out


def piece(text: str, number: int) -> str:
    """A stretch of the text; its length and place follow from the number."""
    size = PIECES[number % len(PIECES)]
    raw = text.encode()
    start = number // len(PIECES) % max(1, len(raw) - size + 1)
    return raw[start : start + size].decode(errors="ignore")


def octave(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), OCTAVES - 1)


@dataclass
class Model:
    """languages of the centroids, the centroids, the radii of each centroid by octave of n-grams, the n-gram weights."""

    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def judge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centroid, cosine, rejected) of each row of n-gram counts."""
        cosine = np.clip(normalised(raw, self.idf) @ self.centroids.T, 0, 1)
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(raw)), best].astype(float)
        return best, top, (top <= 0) | (1 - top > self.radii[best, octave(raw.sum(axis=1))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """(language, score, rejected) of each text; 'und' for a text without a letter, or if nothing was learned."""
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        use = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for i in range(0, len(use), 512):
            part = use[i : i + 512]
            for k, c, s, far in zip(part, *self.judge(counts([texts[k] for k in part])), strict=True):
                lang[k], score[k], rejected[k] = self.languages[c], round(s, 6), bool(far)
        return lang, score, rejected


def normalised(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(raw) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _moved(x: np.ndarray, centres: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _seeds(x: np.ndarray, k: int, chance: np.random.Generator) -> np.ndarray:
    """k-means++: each next one with a chance in proportion to the squared distance to the nearest one so far."""
    seeds = [int(chance.integers(len(x)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        weight = np.maximum(1 - near, 0).astype(float) ** 2
        if weight.sum() < 1e-9:
            break
        seeds.append(int(chance.choice(len(x), p=weight / weight.sum())))
        near = np.maximum(near, x @ x[seeds[-1]])
    return x[seeds]


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, the best of four runs, without clusters of less than SHARE of the rows: the same for the same rows."""
    chance, best, value = np.random.default_rng(0), None, None
    for _ in range(4):
        centres = _moved(x, _seeds(x, k, chance), 12)
        while len(centres) > 1:
            sizes = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
            if sizes.min() >= max(2, SHARE * len(x)):
                break
            centres = _moved(x, np.delete(centres, sizes.argmin(), axis=0), 6)
        found = (len(centres), float((x @ centres.T).max(axis=1).sum()))
        if value is None or found > value:
            best, value = centres, found
    return best


def fit_rows(rows: list[tuple[str, str]], clusters: int = CLUSTERS) -> Model:
    """(language, text) rows to a model."""
    rows = sorted(rows)
    pieces = [piece(t, xxhash.xxh32_intdigest(t)) for _, t in rows]
    return fit_counts([lang for lang, _ in rows], counts([t for _, t in rows]), counts(pieces), clusters)


def fit_counts(langs: list[str], raw: np.ndarray, pieces: np.ndarray, clusters: int = CLUSTERS) -> Model:
    """The model of rows given as n-gram counts of their texts and of a piece of each."""
    if not len(raw):
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, OCTAVES)), np.ones(DIMENSIONS, np.float32))
    langs = np.array(langs)
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    x = normalised(raw, idf)
    names, centres = [], []
    for lang in sorted(set(langs.tolist())):
        found = _clusters(x[langs == lang], clusters)
        names += [lang] * len(found)
        centres.append(found)
    names, centres = np.array(names), np.concatenate(centres)
    # labels have errors: a cluster goes if most vectors that are nearest to it carry another language
    own = (x @ centres.T).argmax(axis=1)
    share = np.array([np.mean(langs[own == c] == n) if (own == c).any() else 0.0 for c, n in enumerate(names)])
    best = {n: share[names == n].max() for n in set(names.tolist())}
    keep = np.array([s > 0.5 or s == best[n] for n, s in zip(names.tolist(), share, strict=True)])
    names, centres = names[keep], centres[keep]
    cosine = np.concatenate([x, normalised(pieces, idf)]) @ centres.T
    near, labels = names[cosine.argmax(axis=1)], np.concatenate([langs, langs])
    far, at = 1 - cosine.max(axis=1), octave(np.concatenate([raw.sum(axis=1), pieces.sum(axis=1)]))
    every = _radii(far[near == labels], at[near == labels], np.ones(OCTAVES))
    radii = {n: _radii(far[(labels == n) & (near == n)], at[(labels == n) & (near == n)], every) for n in set(names.tolist())}
    return Model(names.tolist(), centres.astype(np.float32), np.stack([radii[n] for n in names.tolist()]), idf)


def _radii(far: np.ndarray, at: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """By octave, from distances and their octaves; ``otherwise`` where there are too few of them."""
    out = otherwise.copy()
    for k in range(OCTAVES):
        own = far[at == k]
        if len(own) >= MEMBERS:
            radius = float(np.quantile(own, QUANTILE))
            out[k] = radius + SLACK * (1 - radius)
        elif k and otherwise[k] == 1:
            # longer than any member: as far as the longest ones
            out[k] = out[k - 1]
    return np.maximum.accumulate(out[::-1])[::-1]


def learnable(id_column: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 3, is not 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learns from text and non-null language of learnable rows with a letter. ``sample`` rows are used; half as many again, and 16 of each language, may reach the
    driver, as packed counts of about 2 KB.

    Rows that repeat an id are rows of their own, rows that repeat id and text are one; of equal hashes the smaller language and counts come first. Texts of any length are counted whole, in segments, without
    clipping. No labelled rows give a model that answers 'und' and rejects everything. Other columns have no part in it, whatever their names.
    """
    session(docs)
    ident = field(docs, id_column)
    text = field(docs, text_column).cast("string")
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    rows = docs.where(learnable(ident) & field(docs, lang_column).isNotNull())
    rows = rows.select(field(docs, lang_column).cast("string").alias("l"), digest.alias("h"), text.alias("t"))
    # copies of a row count once; to a few hundredths, for which there is room below
    sizes = {r.l: max(1, r.n) for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.03).alias("n")).collect()}
    if not sizes:
        return fit_rows([])
    each = max(2, sample // len(sizes))
    # the smallest hashes of a language lie below this share of the hash space, with room for chance: no sort, no window
    below = {lang: min(1 << 32, ((each + each // 2 + 16) << 32) // n) for lang, n in sizes.items()}
    bound = F.element_at(F.create_map(*(F.lit(x) for pair in below.items() for x in pair)), F.col("l"))
    chosen = rows.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") < bound).where(F.col("t").rlike(r"\p{L}"))
    # copies of a row, however many there are, are one before anything leaves a task
    chosen = chosen.dropDuplicates(["l", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            own = counts(texts), counts([piece(t, int(h[:12], 16)) for t, h in zip(texts, hashes, strict=True)])
            packed = (pa.array([zlib.compress(r.astype("<u4").tobytes(), 1) for r in part], pa.binary()) for part in own)
            yield pa.record_batch([batch.column(0), batch.column(1), *packed], names=["l", "h", "c", "p"])

    found, taken = [], Counter()
    for r in sorted(map_rows(chosen, ["l", "h", "t"], run, "l string, h string, c binary, p binary").collect(), key=lambda r: (r.h, r.l, bytes(r.c))):
        if taken[r.l] < each:
            taken[r.l] += 1
            found.append((r.l, r.h, bytes(r.c), bytes(r.p)))
    if not found:
        return fit_rows([])
    found.sort()
    raw, pieces = (np.stack([np.frombuffer(zlib.decompress(r[c]), "<u4") for r in found]).astype(np.float32) for c in (2, 3))
    return fit_counts([r[0] for r in found], raw, pieces, clusters)


def predict(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score (0 to 1) and rejected.

    Null, empty and letterless texts are 'und', score 0, rejected; so is everything if nothing was learned. Of equally near centroids the first
    one counts, in the order of languages. Repeated rows are answered one by one, very long texts are counted in segments. An empty table gives
    an empty one; other columns, whatever their names, are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS * 16 KB for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["i", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = map_rows(docs, [field(docs, id_column).alias("i"), field(docs, text_column).cast("string").alias("t")], run, f"i {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("i", id_column)


def known_language(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whatever their names, that the model doesn't reject: null, empty and letterless texts go. Repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_column, lambda texts: [not r for r in shared.value.predict(texts)[2]])
