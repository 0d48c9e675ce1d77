import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import metrics as M


def test_resampled_sums_are_of_n_draws(spark):
    rows = spark.createDataFrame([(k, "a" if k < 300 else "b", float(k)) for k in range(500)], "k int, g string, v double").withColumn("one", F.lit(1.0))
    out = M.resampled_sums(rows, "k", ["v", "one"], replicates=400, seed=5, by=["g"]).toPandas()
    assert (out[out.g == "a"].one == 300).all() and (out[out.g == "b"].one == 200).all() and len(out) == 800
    means = out[out.g == "a"].v / 300
    # the mean of 0..299 and its standard error
    assert abs(means.mean() - 149.5) < 1 and abs(means.std() - np.std(np.arange(300)) / math.sqrt(300)) < 0.6
    again = M.resampled_sums(rows.repartition(7).orderBy(F.col("v").desc()), "k", ["v", "one"], replicates=400, seed=5, by=["g"]).toPandas()
    assert out.sort_values(["g", "replicate"]).reset_index(drop=True).equals(again.sort_values(["g", "replicate"]).reset_index(drop=True))
    assert M.resampled_sums(rows.limit(0), "k", ["v"], replicates=9, seed=5).count() == 0


def test_intervals_follow_theory(spark):
    random.seed(2)
    rows = [(c, random.gauss(c % 10, 1.0)) for c in range(400) for _ in range(3)]
    df = spark.createDataFrame(rows, "c int, v double")
    r = M.bootstrap_interval(df, "c", "v", replicates=4000, seed=1).first()
    means = np.array([np.mean([v for k, v in rows if k == c]) for c in range(400)])
    half = 1.96 * means.std() / 20
    assert r.clusters == 400 and r.estimate == pytest.approx(means.mean()) and r.lower == pytest.approx(means.mean() - half, abs=0.03) and r.upper == pytest.approx(means.mean() + half, abs=0.03)
    p = M.paired_interval(df, df.withColumn("v", F.col("v") + 0.5), "c", "v", replicates=500).first()
    assert (p.estimate, p.lower, p.upper) == pytest.approx((0.5, 0.5, 0.5)) and p.candidate - p.baseline == pytest.approx(0.5)
    with pytest.raises(Exception, match="arms differ"):
        M.paired_interval(df, df.where("c > 0"), "c", "v", replicates=10).collect()


DOCS = "id int, g string, tokens bigint, utf8_bytes bigint, nll_nats double, correct_tokens bigint"


def documents(seed, shift):
    random.seed(seed)
    return [(k, "xy"[k % 2], 10 + k % 7, 40 + k % 11, 30 + k % 5 + random.random() + shift, k % 6) for k in range(300)]


def test_document_scores(spark):
    rows = documents(1, 0)
    out = {r.g: r for r in M.document_scores(spark.createDataFrame(rows, DOCS), "g").collect()}
    for g in ("x", "y", None):
        own = [r for r in rows if g in (None, r[1])]
        tokens, size, nll, right = (sum(r[k] for r in own) for k in (2, 3, 4, 5))
        assert (out[g].documents, out[g].cross_entropy, out[g].bits_per_byte, out[g].top1) == pytest.approx((len(own), nll / tokens, nll / (math.log(2) * size), right / tokens))
    assert M.document_scores(spark.createDataFrame([], DOCS)).first().bits_per_byte is None


def test_paired_documents(spark):
    a, b = (spark.createDataFrame(documents(1, s), DOCS) for s in (0, 0.4))
    out = {r.metric: r for r in M.paired_documents(a, b, "id", replicates=2000, seed=3).collect()}
    tokens, size = (sum(r[k] for r in documents(1, 0)) for k in (2, 3))
    assert out["cross_entropy"].estimate == pytest.approx(-0.4 * 300 / tokens) and out["bits_per_byte"].estimate == pytest.approx(-0.4 * 300 / size / math.log(2))
    ce = out["cross_entropy"]
    assert ce.lower < ce.estimate < ce.upper and (ce.wins, ce.losses, ce.ties) == (1, 0, 0) and (out["top1"].wins, out["top1"].losses, out["top1"].ties) == (0, 0, 1)
    assert M.paired_documents(b, a, "id", replicates=100).where("metric = 'cross_entropy'").first().losses == 1
    for bad in (a.where("id > 0"), a.union(a.limit(1)), a.withColumn("tokens", F.col("tokens") + 1)):
        with pytest.raises(Exception, match="aren't aligned"):
            M.paired_documents(a, bad, "id", replicates=5).collect()


def test_student_values():
    assert [round(M.t_critical(k), 3) for k in (1, 2, 3, 10, 30)] == [12.706, 4.303, 3.182, 2.228, 2.042] and round(M.t_critical(5, 0.99), 3) == 4.032


def test_seed_deltas(spark):
    a, b = (spark.createDataFrame([("m", s, v) for s, v in enumerate(vs)], "metric string, seed int, v double") for vs in ((3.0, 2.0, 5.0), (1.0, 2.5, 4.0)))
    r = M.seed_deltas(a, b, "seed", "v", ["metric"]).first()
    d = np.array([2.0, -0.5, 1.0])
    assert (r.mean, r.median, r.sd, r.wins, r.losses, r.ties, r.p_value) == pytest.approx((d.mean(), 1.0, d.std(ddof=1), 2, 1, 0, 1.0))
    assert r.upper - r.mean == pytest.approx(4.302653 * d.std(ddof=1) / math.sqrt(3), rel=1e-5)
    assert M.seed_deltas(a, b, "seed", "v", ["metric"], higher_is_better=False).first().wins == 1
    with pytest.raises(Exception, match="one arm only"):
        M.seed_deltas(a, b.where("seed > 0"), "seed", "v", ["metric"]).collect()


def test_floors(spark):
    rows = [("Go to Oslo", "walk", '{"to":"oslo","n":3}'), ("Go to Oslo", "walk", '{"to":"oslo","n":3}'), ("Go to Oslo", "stop", None), ("3 times", "walk", '{"n":3}'), ("x", "walk", "{}")]
    r = M.floors(spark.createDataFrame(rows, "observation string, gold_name string, gold_arguments string")).first()
    assert (r.rows, r.majority, r.constant, r.no_arguments, r.derivability, r.fully_derivable, r.reachable) == pytest.approx((5, 0.8, 0.2, 0.4, 3 / 5, 3 / 5, 4 / 5))


def test_clean_subset(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (False, False), (True, None)], "ok boolean, leaked boolean")
    out = {r.subset: r for r in M.rates_and_clean(rows, F.col("leaked"), {"step": F.col("ok")}).collect()}
    assert (out["all"].rows, out["all"].step, out["clean"].rows, out["clean"].step, out["clean"].leaked_rows) == (4, 0.5, 2, 0.5, 2)
    none = {r.subset: r for r in M.rates_and_clean(rows.where("leaked"), F.col("leaked"), {"step": F.col("ok")}).collect()}["clean"]
    assert (none.rows, none.step, none.leaked_rows) == (0, None, 2)


def test_suites_and_categories(spark):
    results = spark.createDataFrame([("s", "a", 1.0, ["x", "aug"]), ("s", "b", 0.5, ["x"]), ("t", "a", 1.0, ["y"]), ("t", "a", 0.0, ["y"]), ("u", "z", 1.0, [])], "suite string, case string, v double, c array<string>")
    expected = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a"), ("t", "b"), ("w", "a")], "suite string, case string")
    out = {r.suite: r for r in M.suite_report(results, expected, suite="suite", case="case", value="v", failed=F.col("v") == 0).collect()}
    assert (out["s"].status, out["s"].cases, out["s"].mean, out["s"].exact) == ("complete", 2, 0.75, 0.5)
    assert (out["t"].status, out["t"].duplicates, out["t"].missing, out["t"].failures) == ("incomplete", 1, 1, 1) and out["u"].unexpected == 1 and (out["w"].cases, out["w"].mean, out["w"].missing) == (0, None, 1)
    by = {r.category: r.n for r in M.by_category(results, "c", "v", unless={"x": ["aug"]}).collect()}
    assert by == {"x": 1, "aug": 1, "y": 2, "ALL_CATEGORIES": 5}


def test_retrieval_by_size_and_selection(spark):
    rows = spark.createDataFrame([(10, 1, True, True), (10, 3, True, False), (50, None, False, True)], "size int, rank int, sel boolean, arg boolean")
    out = {r["size"]: r for r in M.retrieval_by_size(rows, "rank", "size", F.col("sel") & F.col("arg"), (1, 4)).collect()}
    assert (out[10].recall_1, out[10].recall_4, out[10].end_to_end, out[50].mrr) == (0.5, 1.0, 0.5, 0.0)
    r = M.selection_and_arguments(rows, F.col("sel"), F.col("arg")).first()
    assert (r.selection, r.arguments_given_selection, r.both) == pytest.approx((2 / 3, 1 / 2, 1 / 3))
