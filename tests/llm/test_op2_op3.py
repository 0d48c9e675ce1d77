import collections
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from grainmill.llm import language_id as G
from grainmill.llm import url_rules as U

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, G.fit(docs)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    found = G.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(~G.learnable(F.col("doc_id"))).toPandas()
    assert len(found) > 250 and (found.lang_pred == found.lang).mean() > 0.97 and found.rejected.mean() < 0.01
    assert found.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark, fitted):
    docs, model = fitted
    other = docs.withColumn("lang", F.when(G.learnable(F.col("doc_id")), F.col("lang")).otherwise("xx"))
    again = G.fit(other)
    assert again.languages == model.languages and np.array_equal(again.centroids, model.centroids)


def plain_prediction(model, text):
    """n-grams in a dictionary, one centroid at a time."""
    raw = b" " + text.lower().encode() + b" "
    raw = bytes(b if b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in raw)
    seen = collections.Counter()
    for n in (2, 3):
        for k in range(len(raw) - n + 1):
            gram = raw[k : k + n]
            if gram.strip(b" "):
                value = int.from_bytes(gram, "big") | (1 << 24 if n == 2 else 0)
                seen[(value * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    x = {k: math.log1p(c) * float(model.idf[k]) for k, c in seen.items()}
    length = math.sqrt(sum(v * v for v in x.values())) or 1.0
    cosine = [sum(v * float(c[k]) for k, v in x.items()) / length for c in model.centroids]
    best = max(range(len(cosine)), key=lambda c: (cosine[c], -c))
    beyond = 1 - cosine[best] - model.radii[best][min(23, int(math.log2(max(1, sum(seen.values())))))]
    return model.languages[best], min(1, max(0, cosine[best])), beyond, sorted(cosine)


def test_predictions_equal_brute_force(fitted):
    docs, model = fitted
    texts = [r.text for r in docs.where("doc_id % 7 = 0").collect() if G.has_letter(r.text)] + ["a", "zażółć gęślą jaźń", "Это русский текст", "the of and"]
    lang, score, rejected = model.predict(texts)
    assert len(texts) > 100
    for t, own, s, no in zip(texts, lang, score, rejected, strict=True):
        want, cosine, beyond, all_of_them = plain_prediction(model, t)
        assert abs(cosine - s) < 1e-5 and (own == want or all_of_them[-1] - all_of_them[-2] < 1e-5) and (no == (beyond > 0) or abs(beyond) < 1e-5)


def test_rejection(fitted):
    _, model = fitted
    lang, score, rejected = model.predict([None, "", "12 !! 34", "Это русский текст, совсем не похожий на другие. " * 5, "zażółć gęślą jaźń " * 20])
    assert lang[:3] == ["und"] * 3 and not score[:3].any() and all(rejected)
    assert all(model.predict(["Это русский текст", "zażółć gęślą jaźń", "日本語の文章です", "ελληνικό κείμενο εδώ"])[2])


@pytest.fixture(scope="module")
def counted():
    """N-gram counts of labelled texts and of their pieces, and which rows are held out."""
    rows = [r for r in pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist()[:4000] if r["lang"] and G.has_letter(r["text"])]
    pieces = [G.piece(r["text"], xxhash.xxh32_intdigest(r["text"])) for r in rows]
    return np.array([r["lang"] for r in rows]), G.counts([r["text"] for r in rows]), G.counts(pieces), np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows])


def sample(langs, held, names, seed, each):
    at = np.random.default_rng(abs(seed)).permutation(len(langs)) if seed >= 0 else np.arange(len(langs))
    return np.concatenate([[k for k in at if langs[k] == n and not held[k]][:each] for n in names]).astype(int)


@pytest.mark.parametrize("out", ["de", "en", "es", "fr"])
@pytest.mark.parametrize("seed", [0, 1, -1])
def test_a_language_left_out_is_rejected(counted, out, seed):
    langs, raw, pieces, held = counted
    rows = sample(langs, held, sorted(set(langs.tolist()) - {out}), seed, 500)
    model = G.fit_counts(langs[rows].tolist(), raw[rows], pieces[rows])
    no = model.judge(raw[held])[2]
    assert no[langs[held] == out].mean() >= 0.9 and no[langs[held] != out].mean() <= 0.02


@pytest.mark.parametrize("seed", [0, 1, -1])
def test_clusters_are_real(counted, seed):
    """Every centroid has a share of its language's rows; several clusters are as good as one."""
    langs, raw, pieces, held = counted
    names = sorted(set(langs.tolist()))
    rows = sample(langs, held, names, seed, 500)
    right = {}
    for k in (1, 4):
        model = G.fit_counts(langs[rows].tolist(), raw[rows], pieces[rows], k)
        own = np.array(model.languages)
        best = model.judge(raw[held])[0]
        right[k] = (own[best] == langs[held]).mean()
        for n in names:
            x = G.normalised(raw[rows][langs[rows] == n], model.idf) @ model.centroids[own == n].T
            assert np.bincount(x.argmax(axis=1), minlength=x.shape[1]).min() >= G.SHARE * len(x)
            assert k == 1 or x.shape[1] > 1
    assert right[4] >= right[1] - 0.001 and right[4] > 0.99


def test_a_hot_id_and_letterless_texts(spark):
    """Rows that share an id are sampled apart, copies of a row count once, and labels without a letter teach nothing."""
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("some words of row "), F.col("id") % 3000).alias("text"), F.lit("en").alias("lang"))
    learn = docs.where(G.learnable(F.col("doc_id")))
    assert learn.count() == 4000 and G.fit(docs, sample=100).languages
    same = docs.withColumn("text", F.lit("always the same words here"))
    assert G.fit(same, sample=100).languages == ["en"]
    assert G.fit(docs.withColumn("text", F.lit("12 34"))).languages == []


def test_counts_are_of_the_whole_text():
    random.seed(1)
    text = "".join(random.choice("abc déf ") for _ in range(3000))
    whole = G.counts([text])[0]
    old, G.SEGMENT = G.SEGMENT, 1000
    try:
        pieces = G.counts([text])[0]
    finally:
        G.SEGMENT = old
    assert np.abs(whole - pieces).sum() <= 4  # a cut counts its 2-gram twice at most
    assert np.array_equal(G.counts(["x y", text, "z", "", "a"])[1], whole)
    raw = (" " + text + " ").encode()
    assert whole.sum() == sum(raw[i : i + n] != b" " * n for n in (2, 3) for i in range(len(raw) - n + 1))


def test_languages_of_odd_tables(odd, none, clash, fitted):
    _, model = fitted
    empty = G.fit(none)
    assert {r.lang_pred for r in G.predict(odd, empty).collect()} == {"und"} and G.predict(none, model).count() == 0
    assert G.predict(clash, G.fit(clash)).count() == clash.count()
    kept = G.known_language(clash, model)
    assert kept.columns == clash.columns and kept.where("text is null").count() == 0


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"


def test_rules_equal_brute_force(spark):
    random.seed(4)
    labels, rows = ["a", "ab", "b", "net", "org", "x-y"], []
    for k in range(600):
        host = ".".join(random.choice(labels) for _ in range(random.randrange(1, 5)))
        rows.append((k, f"http://{host.upper() if k % 5 == 0 else host}" + random.choice(["", "/", "/en/x", "/en", "/de/y?q=/en/", "?a", "#b", "/de/#x"])))
    rows += [(600, None), (601, ""), (602, "no scheme/en/"), (603, "x://"), (None, "http://a.net/"), (604, "http://a..net/"), (604, "http://a..net/")]
    rows += [(1000 + k, "http://hot.net/en/") for k in range(500)]
    rows += [(2000, "http://net\x01x/a"), (2001, "http://a\x01net/"), (2002, "http://x.a\x02.net/"), (2003, "http://net\x02\x11/"), (2004, "http://a\x01.net/en/"), (2005, "http://b.net/" + "en/" * 100_000), (2006, "http://" + "a." * 20_000 + "net/")]
    rules = sorted({(".".join(random.choice(labels) for _ in range(random.randrange(1, 4))), random.choice(["", "/", "/en/", "/de/"]), random.choice(["allow", "block"])) for _ in range(40)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values()) + [("hot.net", "/", "block"), ("hot.net", "/", "allow")]
    got = U.apply_rules(spark.createDataFrame(rows, "page_id bigint, url string"), U.rule_table(spark, rules)).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(str((k, *brute(u, rules))) for k, u in rows)


def test_very_many_rules_of_one_host(spark):
    import time

    entry = U.Entry("net\x01", "net")
    for k in range(200_000):
        entry.add(f"/p{k:06}/", "block")
    entry.add("/p00", "allow")
    began = time.process_time()
    assert all(entry.best(f"/p{k:06}/x")[2] == f"net/p{k:06}/" for k in range(50_000)) and entry.best("/p00x")[3] == "allow" and entry.best("/q") is None
    assert time.process_time() - began < 2


def test_clashing_names(spark):
    rows = [(k, f"http://a{k % 5}.net/en/{k}") for k in range(50)] + [(None, None), (1, "http://a1.net/en/1")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string")
    clash = frame.select("*", *(F.lit(1).alias(c) for c in ("part", "key", "kind", "i", "host", "path", "verdict", "rule", "salted", "a.b")))
    want = sorted(map(str, U.apply_rules(frame, U.rule_table(spark)).collect()))
    assert sorted(map(str, U.apply_rules(clash, U.rule_table(spark)).collect())) == want and len(want) == len(rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", 5)], "page_id bigint, url string, part int")
    none = U.rule_table(spark, [("", "/", "block")])
    assert [r.verdict for r in U.apply_rules(pages, none).collect()] == ["allow"]
    assert U.apply_rules(pages.limit(0), U.rule_table(spark)).count() == 0
