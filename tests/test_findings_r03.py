"""The findings of the third round."""

import random

from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import quality, similarity


def test_simhash_makes_features_of_documents_in_near_pairs_only(spark, monkeypatch):
    """The features of every document, 2 KB each, were written and read again, and texts moved for exact dedup."""
    draw = random.Random(7)
    rows = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(60))) for i in range(200)]
    rows += [(1000, rows[0][1] + " more"), (1001, rows[0][1]), (None, rows[1][1]), (1002, None)]
    docs, written, own = spark.createDataFrame(rows, "doc_id bigint, text string"), [], similarity.parquet_checkpoint
    monkeypatch.setattr(similarity, "parquet_checkpoint", lambda s: lambda df: [written.append(own(s)(df)), written[-1]][1])
    got = {r.doc_id: (r.class_id, r.links) for r in similarity.simhash_classes(docs, max_hamming=7, min_jaccard=0.5).collect()}
    assert got == {i: (i, 0) for i in range(1, 200)} | {0: (0, 2), 1000: (0, 2), 1001: (0, 2)}
    wide = [w for w in written if any(t.startswith("array") for _, t in w.dtypes)]
    assert [w.count() for w in wide] == [2] and not any("text" in w.columns for w in written)


def _odd_documents(n=1500, seed=11):
    draw = random.Random(seed)
    bits = ["\r\n", "\r", "\n", " ", "\x85", "\x1c", "\x0b", " ", "　", "\xa0", "\t", "import os", "def f", "const x =", "};", "{ // a", "; //", "#include", "var y=", "classé x", "  from  a", "�", "\x01", "ß", "İ", "\U0001f600", "²", "_a", "١"]
    rows = []
    for i in range(n):
        if i % 5 == 4:
            # a copy but for white space, of a smaller or greater id
            text = rows[draw.randrange(len(rows))][1].replace(" ", draw.choice([" ", "  ", " \t"]))
        else:
            line = lambda: " ".join(draw.choice(["alpha", "Beta", "gamma,", f"w{draw.randrange(99)}"]) for _ in range(draw.randint(3, 9)))
            lines = [line() for _ in range(draw.randint(2, 6))]
            parts = [x for _ in range(draw.randint(3, 12)) for x in (draw.choice(lines), draw.choice(["\n", "\n", *bits]), draw.choice(["", "\n", *bits]))]
            text = "".join(parts)
        rows.append((draw.choice([i, n - i, i % 7 * 100]), text, draw.choice(["src0", "src1", "a/b.py", "GitHub x", "http://h/x.js?q", None])))
    filler = " ".join(f"w{k}" for k in range(60))
    rows += [(None, filler, "s"), (3, None, "s"), (4, "", "s"), (5, "x" * 2_000_001, "s"), (6, filler + "\x01" * 3, "s"), (7, filler + "\x01" * 2, "s"), (8, "a " * 150, "s"), (9, f"\x85{filler} import x const y =1", "s")]
    return rows


def test_good_marks_equal_quality_filter_and_code_like(spark):
    docs = spark.createDataFrame(_odd_documents(), "doc_id bigint, text string, source string").repartition(5)
    plain = quality.quality_filter(docs).where(~X.code_like(F.col("text"), F.col("source")))
    want = similarity.sampled_simhash(plain).where("k IS NOT NULL AND size(features) >= 8").collect()
    got = similarity.good_simhash_marks(docs).collect()
    assert sorted((r.k, r.signature) for r in got) == sorted((r.k, r.signature) for r in want) and len(want) > 100
    assert len({(r.signature, r.d) for r in got}) == len({tuple(r.features) for r in want})
    assert similarity.good_simhash_marks(docs.limit(0)).count() == 0


def test_python_text_rules_equal_the_expressions(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(_odd_documents(600, 12)) if t is not None], "i bigint, text string")
    clean = X.quality_text(F.col("text"))
    rows = docs.select("text", clean.alias("clean"), (X.quality_reason(F.col("text")) == "").alias("good"), X.tokens(clean, True).alias("w"), X.code_like(clean, F.lit("s")).alias("code")).collect()
    for r in rows:
        assert X.clean_text(r.text) == r.clean and X.text_tokens(r.clean) == r.w and X.code_signals(r.clean) == r.code and (X.good_text(r.text) is not None) == r.good
    assert {r.good for r in rows} == {r.code for r in rows} == {True, False}
