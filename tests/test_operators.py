import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from grainmill.functions import canonical
from grainmill.functions import text as X
from grainmill.operators import conversations, dom, governance, metrics, packing, quality, selection, similarity
from grainmill.operators.ranking import global_rank


def one(spark, expression, **values):
    return spark.createDataFrame([Row(**values)]).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("a" * 199, "too_short"),
        ("  " + "word " * 50, ""),
        ("x" * 300 + "\x01" * 4, "control_characters"),
        ("x" * 300 + "�", "replacement_characters"),
        ("the same line is here again\n" * 20, "repetitive"),
        ("a" * 2_000_001, "too_long"),
    ],
)
def test_quality_reasons(spark, text, reason):
    assert one(spark, X.quality_reason(F.col("t")), t=text) == reason


def test_quality_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(X.quality_reason(F.col("t")).alias("x")).first().x == "missing_text"


def test_line_ends_and_repetition(spark):
    text = "this line is long enough\r\nTHIS  line is long enough\x0bthis line is long enough\x85short"
    assert one(spark, X.repetition_ratio(F.col("t")), t=text) == pytest.approx(2 / 3)


@pytest.mark.parametrize(("number", "valid"), [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("0000000000000000", False), ("42", False)])
def test_luhn(spark, number, valid):
    assert one(spark, X.luhn_valid(F.col("n")), n=number) is valid


def test_privacy(spark):
    text = "mail a.b@example.org, password: hunter22, 123-45-6789, tel: +1 (555) 123-4567, card 4111-1111-1111-1111"
    assert one(spark, X.privacy_reasons(F.col("t")), t=text) == ["email", "labeled_phone", "labeled_secret", "payment_card", "ssn"]


@pytest.mark.parametrize(
    ("source", "family"),
    [
        ("https://User@Www.Example.org:80/x", "web:www.example.org"),
        ("hf://datasets/a/b/c", "dataset:a/b"),
        ("ftp://x/y", "scheme:ftp"),
        ("a/b.TXT", "file:.txt"),
        ("a/b", "file:no-extension"),
        ("books", "named:books"),
    ],
)
def test_source_family(spark, source, family):
    assert one(spark, X.source_family(F.col("s")), s=source) == family


def test_bounded_label(spark):
    out = one(spark, X.bounded_label(F.col("s")), s="x" * 500)
    assert len(out) == 138 + 2 + 20 and out.startswith("x" * 138 + "…#")


@pytest.mark.parametrize(("text", "limit", "out"), [("héllo", 2, "h"), ("héllo", 3, "hé"), ("日本", 5, "日"), ("a😀", 4, "a"), ("ab", 9, "ab")])
def test_truncate_utf8(spark, text, limit, out):
    assert one(spark, X.truncate_utf8(F.col("t"), limit), t=text) == out


def test_code_like(spark):
    assert one(spark, X.code_like(F.col("t"), F.col("s")), t="import os\nx = {}\nfoo();\n", s="named")
    assert one(spark, X.code_like(F.col("t"), F.col("s")), t="prose", s="a/b.PY")
    assert not one(spark, X.code_like(F.col("t"), F.col("s")), t="prose", s="books")


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": [true, "é"]}',), ('{"a":1,"a":2}',), ("NaN",), (None,)], "t string")
    assert [r.x for r in rows.select(canonical.canonical_json("t").alias("x")).collect()] == ['{"a":[true,"é"],"b":1}', None, None, None]
    assert [r.x for r in rows.limit(1).select(canonical.json_type(F.lit("true")).alias("x"), canonical.compatible_fold(F.lit(" ﬁX  y"))).collect()] == ["boolean"]


def test_exact_dedup_is_order_independent(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [("two", text, "s"), ("one", text.replace(" ", "\n"), "s"), ("three", "short", "s")]
    for some in (rows, rows[::-1]):
        out = quality.quality_filter(spark.createDataFrame(some, "doc_id string, text string, source string")).collect()
        assert [r.doc_id for r in out] == ["one"]


def test_aliases_are_what_dedup_drops(spark):
    rows = [(i, "d%d" % (i % 3), "s%d" % (i % 2)) for i in range(20)]
    out = quality.aliases(spark.createDataFrame(rows, "k int, d string, s string"), "d", "k", ["s"]).agg(F.sum("occurrences")).first()[0]
    assert out == 20 - 3


def test_near_dup_keeps_the_longer(spark):
    base = [f"agent_token_{i}" for i in range(80)]
    rows = [("near", " ".join([*base, "extra"])), ("base", " ".join(base)), ("other", " ".join(f"unrelated_{i}" for i in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    cut = similarity.parquet_checkpoint(spark)
    pairs = similarity.jaccard_pairs(docs, min_jaccard=0.95)
    ranked = global_rank(docs.withColumn("g", F.lit(0)), "g", [F.length("text").desc()]).select(F.col("doc_id").alias("k"), "rank")
    kept = {r.k for r in similarity.greedy_survivors(ranked, pairs, cut).where("keep").collect()}
    assert kept == {"near", "other"}
    assert {(r.a, r.b) for r in similarity.simhash_pairs(docs).collect()} == {("base", "near")}


def test_greedy_is_not_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    ranked = spark.createDataFrame([(i, i) for i in range(1, 6)], "k int, rank int")
    out = similarity.greedy_survivors(ranked, pairs, similarity.parquet_checkpoint(spark))
    assert sorted(r.k for r in out.where("keep").collect()) == [1, 3, 5]


def test_char_grams_match_python(spark):
    import zlib
    from collections import Counter
    from math import sqrt

    text = "Abracadabra abra"
    low = text.lower()
    counts = Counter(zlib.crc32(low[i : i + n].encode()) % 8192 for n in (3, 4, 5) for i in range(len(low) - n + 1))
    norm = sqrt(sum(v * v for v in counts.values()))
    got = one(spark, similarity.char_grams(F.col("t")), t=text)
    assert got == pytest.approx({k: v / norm for k, v in counts.items()})
    assert one(spark, similarity.char_grams(F.col("t")), t="") == {}


def test_global_rank_is_a_row_number(spark):
    random.seed(1)
    rows = [(i, random.randrange(1000), random.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int, g string").withColumn("c", F.floor(F.col("v") / 50))
    got = {r.i: r["rank"] for r in global_rank(df, "c", [F.col("v"), F.col("i")], by=["g"]).collect()}
    for g in "ab":
        want = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))
        assert [got[r[0]] for r in want] == list(range(len(want)))


def test_split_is_exact_disjoint_and_order_independent(spark):
    docs = spark.createDataFrame([(f"doc-{i}", f"document body {i}") for i in range(20)], "doc_id string, text string")
    a = {r.doc_id: r.split for r in selection.split_documents(docs, 0.2, 17).collect()}
    b = {r.doc_id: r.split for r in selection.split_documents(docs.orderBy(F.col("doc_id").desc()).repartition(3), 0.2, 17).collect()}
    assert a == b and list(a.values()).count("val") == 4
    assert selection.split_documents(docs.limit(1), 0.2, 17).first().split == "train"


def test_frozen_split_refuses_unknown(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    known = docs.limit(1).select(F.sha2("doc_id", 256).alias("identity"), F.sha2("text", 256).alias("document_sha256"), F.lit("val").alias("split"))
    with pytest.raises(Exception, match="no assignment"):
        selection.frozen_split(docs, known).collect()


def test_apportion_spends_all(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "position int, weight int")
    assert [r.budget for r in selection.apportion(rows, 100).orderBy("position").collect()] == [34, 33, 33]


def test_scheduled_mixture_follows_weights(spark):
    chosen = spark.range(1).select(selection.scheduled_mixture([1.0, 1.0], [1.0, 1.0], 10, [10.0, 10.0]).alias("c")).first().c
    assert chosen == [0, 1] * 5


def test_quota_order_shows_rare_first(spark):
    rows = [("a", f"h{i:02d}") for i in range(10)] + [("b", "h99")]
    out = selection.quota_order(spark.createDataFrame(rows, "s string, h string"), ["s"], "h").orderBy("position").collect()
    assert [r.s for r in out[:2]] == ["b", "a"] and [r["position"] for r in out] == list(range(11))


def test_greedy_cover(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"]), (4, ["a"])], "k int, s array<string>")
    out = selection.greedy_cover(rows, "k", "s", 3)
    assert set(out[:2]) == {1, 3} and len(out) == 3
    with pytest.raises(ValueError):
        selection.greedy_cover(rows, "k", "s", 1)


def test_group_split_keeps_groups(spark):
    rows = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, ["y"]), (4, ["z"])], "k int, h array<string>")
    out = {r.k: r.root for r in selection.disjoint_groups(rows, "k", "h", similarity.parquet_checkpoint(spark)).collect()}
    assert out == {1: "x", 2: "x", 3: "x", 4: "z"}


def test_spread(spark):
    assert spark.range(1).select(selection.spread_positions(10, 4).alias("x")).first().x == [1, 3, 6, 8]


def test_conversation_flags(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "an error"), (1, 2, "assistant", "again"), (2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    rows = {r.conv_id: r for r in conversations.rebuild(turns).select("conv_id", conversations.trainable(F.col("messages")).alias("t"), conversations.recovers(F.col("messages")).alias("r")).collect()}
    assert (rows[1].t, rows[1].r, rows[2].t, rows[2].r) == (True, True, False, False)


def test_catalogs(spark):
    tools = spark.createDataFrame([([("f", "d"), ("g", "e")],)], "t array<struct<name:string,description:string>>")
    masked = tools.select(conversations.masked_catalog(F.col("t"), "s").alias("m"), conversations.rotated(F.col("t"), 1).alias("r")).first()
    assert [m["description"] for m in masked.m] == ["d", "e"] and masked.m[0]["name"].startswith("fn_") and masked.r[0]["name"] == "g"


def test_sign_test_and_rates(spark):
    assert metrics.sign_test(5, 0) == pytest.approx(0.0625) and metrics.sign_test(0, 0) == 1.0
    assert spark.range(3).agg(metrics.rate(F.col("id") > 0, F.col("id") > 9).alias("r")).first().r is None


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("c"), (F.col("id") % 3).cast("double").alias("v"))
    a = metrics.bootstrap_interval(df, "c", "v", replicates=200).first()
    b = metrics.bootstrap_interval(df.repartition(7), "c", "v", replicates=200).first()
    assert a == b and a.lower <= a.estimate <= a.upper and a.clusters == 20


def test_paired_refuses_one_arm(spark):
    a = spark.createDataFrame([("x", 1.0)], "k string, v double")
    with pytest.raises(Exception, match="one arm"):
        metrics.paired(a, a.where("false"), "k", "v").collect()


@pytest.mark.parametrize("length", [4, 7, 32])
def test_packing_loses_nothing(length):
    random.seed(length)
    docs = [[random.randrange(1, 9) for _ in range(random.randrange(0, 30))] for _ in range(40)]
    rows = list(packing.packed(iter(docs), length))
    assert all(len(r) <= length and r[0] == 0 and r[-1] == 0 for r in rows)
    assert [t for r in rows for t in r if t] == [t for d in docs for t in d]


def test_pack_and_pairs(spark):
    docs = spark.createDataFrame([("train", 0, i, f"document {i} é") for i in range(10)], "split string, g int, o int, text string")
    rows = packing.pack(docs.withColumn("ids", packing.byte_ids(F.col("text"))), split="split", group="g", order=["o"], ids="ids", row_tokens=32)
    pairs = packing.pairs(rows, 32).orderBy("row").collect()
    assert bytes(t for r in pairs for t in r.tokens if t).decode() == "".join(f"document {i} é" for i in range(10))
    assert all(len(r.x) == len(r.y) == 31 for r in pairs) and pairs[-1].y.count(-100) == 32 - pairs[-1].length


def test_chat_retrieval_ranks_among_all_turns(spark):
    """Brute force over every conversation; among the query conversations alone the ranks would be better."""
    import zlib
    from collections import Counter

    from grainmill.plans import conversations as plans

    random.seed(4)
    say = lambda: " ".join(random.choice(("alpha", "beta", "gamma", "delta", "licence")) for _ in range(6))
    rows = [(c, t, "assistant" if t % 2 else "user", say()) for c in range(0, 120) for t in range(4)] + [(500 + c, 0, "user", "Alpha beta gamma") for c in range(3)] + [(503, 0, "user", None)]

    def grams(text):
        counts = Counter(zlib.crc32(text.lower()[i : i + n].encode()) % 8192 for n in (3, 4, 5) for i in range(len(text) - n + 1))
        size = sum(v * v for v in counts.values()) ** 0.5
        return {k: v / size for k, v in counts.items()}

    dot = lambda a, b: round(sum(v * b.get(k, 0.0) for k, v in a.items()), 9)
    users = {(c, t): grams(x) for c, t, role, x in rows if role == "user" and x}
    asked = [(c, t - 1, grams(x)) for c, t, role, x in rows if role == "assistant" and c % 50 == 0]
    ranks = [1 + sum(dot(q, g) > dot(q, users[c, t]) for g in users.values()) for c, t, q in asked]
    got = plans.retrieval_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), F.col("conv_id") % 50 == 0).first()
    assert got.n == len(ranks) == 6 and max(ranks) > 12 and got.mrr == pytest.approx(sum(1 / r for r in ranks) / len(ranks))
    assert all(got[f"recall_{k}"] == pytest.approx(sum(r <= k for r in ranks) / len(ranks)) for k in (1, 4, 8, 16, 32))


def test_dom_ranking():
    page = "<html><body><div><p>alpha</p><a href=x>find licence</a></div><script>no</script><p>tail</p></body></html>"
    nodes = dom.nodes_of(page)
    assert [n["tag"] for n in nodes] == ["html", "body", "div", "p", "a", "script", "p"] and "no" not in [n["text"] for n in nodes]
    assert [n["tag"] for n in dom.rank_nodes(nodes, "please find licence", 20)] == ["a"]


def test_dom_of_a_long_page(spark):
    page = "<body>" + "<p>x</p>" * 20_500 + "<a>late licence</a></body>"
    nodes = dom.nodes_of(page)
    assert len(nodes) == 20_502 and nodes[-1]["text"] == "late licence" and nodes[20_500]["text"] == "x"
    pages = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    assert dom.dom_nodes(pages).select(F.size("nodes")).first()[0] == 20_502
    assert dom.ranked_dom(pages, "find the late licence", budget=20).first().observation == "<a> late licence\n"


def test_governance(spark):
    m = governance.manifest({"a": 1})
    governance.verify_manifest(m)
    with pytest.raises(ValueError):
        governance.verify_manifest(m | {"a": 2})
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "v string")
    b = spark.createDataFrame([("y",), ("x",), ("y",)], "v string").repartition(3)
    assert governance.multiset_fingerprint(a, "v").first() == governance.multiset_fingerprint(b, "v").first()
    assert governance.set_fingerprint(a, "v").first() == governance.set_fingerprint(b.distinct(), "v").first()
    with pytest.raises(ValueError):
        governance.derived(a, {"p": ["s"], "q": ["s"]}, "v")


def test_cosine_blocks_equal_all_pairs(spark):
    import numpy as np

    random.seed(5)
    rows = [(k, [random.choice((-1.0, 0.0, 1.0)) for _ in range(4)]) for k in range(150)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    asked = df.where("vec_id % 10 = 0")
    got = sorted(tuple(r) for r in similarity.cosine_top(df, asked, 4, block=3).collect())
    x = {k: np.array(v) for k, v in rows if v}
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 5) if a.any() and b.any() else 0.0
    want = []
    for q in range(0, 150, 10):
        best = sorted((-cos(x[q], x[k]), k) for k in x if k != q)[:4]
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(best)]
    assert got == sorted(want) and similarity.cosine_top(df, asked.limit(0), 4).count() == 0


def test_short_matches_in_blocks(spark, monkeypatch):
    items = [(k, t) for k, t in enumerate(["ab", "b c", "ab", "zz", "", "x " * 40, "É!"])] + [(None, "b")]
    docs = [(k, t) for k, t in enumerate(["drab day", "a b c", "", None, "zzz ab", "é !"])]
    frames = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    norm = lambda t: " ".join(X_TOKEN.findall((t or "").casefold()))
    want = sorted((str(i), d) for i, t in items if t and len(norm(t).split()) < 12 for d, x in docs if norm(t) in norm(x))
    got = lambda: sorted((str(r.item_id), r.doc_id) for r in similarity.short_matches(*frames).collect())
    assert got() == want and want
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 1)
    assert got() == want


X_TOKEN = __import__("regex").compile(r"\w+|[^\w\s]")


def test_signature_keys_lose_no_pair():
    for n in (10, 10**7, 10**10):
        for radius in (3, 7):
            for _ in range(100):
                flipped = sum(1 << b for b in random.sample(range(64), radius))
                assert any(not any(flipped >> shift & (1 << width) - 1 for shift, width in key) for key in similarity.block_choice(n, radius))


def test_cover_and_confirmation(spark):
    rows = [(k, f"s{k % 30}", [f"p{k % 50}"], [f"a{k % 4}", f"b{k % 3}"]) for k in range(90)]
    df = spark.createDataFrame(rows, "k bigint, semantic string, prompts array<string>, strata array<string>")
    out = selection.confirmatory(df, "k", semantic="semantic", prompts="prompts", strata="strata", primary=6, confirm=6).collect()
    first, second = ({r.k for r in out if r.part == p} for p in ("primary", "confirm"))
    by = {r[0]: r for r in rows}
    assert len(first) == len(second) == 6 and {s for k in first for s in by[k][3]} == {s for r in rows for s in r[3]}
    assert not {by[k][1] for k in first} & {by[k][1] for k in second} and not {p for k in first for p in by[k][2]} & {p for k in second for p in by[k][2]}
    free = [r for r in rows if r[1] not in {by[k][1] for k in first} and not {*r[2]} & {p for k in first for p in by[k][2]}]
    assert {s for k in second for s in by[k][3]} == {s for r in free for s in r[3]}


def test_bounded_shuffle_and_widening(spark):
    out = selection.bounded_shuffle(spark.range(1000), "id", 4, 64).collect()
    assert sorted(r.shuffled for r in out) == list(range(1000)) and max(abs(r.shuffled - r.id) for r in out) < 64 and sum(r.id != r.shuffled for r in out) > 900
    base = spark.createDataFrame([(1, ["p1"], 5)], "k int, prompts array<string>, n int")
    extra = spark.createDataFrame([(k, [f"p{k}", f"q{k % 7}"], k) for k in range(10, 60)] + [(99, [], 1)], "k int, prompts array<string>, n int")
    guards = spark.createDataFrame([("q3",), ("p20",)], "prompt string")
    wide = selection.widen(base, extra, guards, key="k", prompts="prompts", size=F.col("n"), most=50, cap=9, seed=2).collect()
    assert sum(r.added for r in wide) == 9 and not any(r.added and (r.k % 7 == 3 or r.k in (20, 99) or r.n > 50) for r in wide)


def test_components_of_a_long_chain(spark):
    from grainmill.operators import graphs
    from grainmill.sources.shared import parquet_checkpoint

    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(200)] + [("x", "y"), ("z", "z"), (None, "q")]
    random.shuffle(edges)
    found = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a string, b string"), parquet_checkpoint(spark)).collect()}
    assert found == {**{f"{k:03}": "000" for k in range(201)}, "x": "x", "y": "x"}


def test_fingerprint_sums_are_modulo_two_to_the_256(spark):
    import hashlib

    values = [f"v{k % 7}" for k in range(50)] + [None]
    r = governance.multiset_fingerprint(spark.createDataFrame([(v,) for v in values], "v string"), "v").first()
    numbers = [int(hashlib.sha256(v.encode()).hexdigest(), 16) for v in values if v]
    xor = 0
    for n in numbers:
        xor ^= n
    assert (r["count"], r["sum"], r["xor"]) == (50, f"{sum(numbers) % 2**256:064x}", f"{xor:064x}")


def test_set_fingerprint_has_more_levels_for_more_values(spark):
    rows = spark.range(3000).withColumnRenamed("id", "v")
    small, large = (governance.set_fingerprint(rows, "v", group_values=g).first() for g in (4096, 2))
    assert small["count"] == large["count"] == 3000 and small.fingerprint != large.fingerprint
    assert governance.set_fingerprint(rows.repartition(9).union(rows.limit(5)), "v", group_values=2).first() == large


def test_encoded_and_shards(spark, tmp_path):
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "hello wörld"), (2, None)], "k int, t string")
    found = {r.k: r.ids for r in packing.encoded(docs, "k", "t", path).collect()}
    from tokenizers import Tokenizer

    assert found == {1: Tokenizer.from_file(path).encode("hello wörld", add_special_tokens=False).ids, 2: []} and packing.token_lengths(docs, "k", "t", path).agg(F.sum("n")).first()[0] == len(found[1])
    rows = spark.createDataFrame([("train", 0, k, [0, 5 + k, 0], 3) for k in range(5)], "split string, grp bigint, row bigint, tokens array<int>, length int")
    made = packing.write_shards(rows, str(tmp_path), 2, 6)
    assert [(s["shard"], s["rows"], s["tokens"]) for s in made["shards"]] == [(0, 2, 6), (1, 2, 6), (2, 1, 3)] and json.loads((tmp_path / "manifest.json").read_text())["row_tokens"] == 6
    assert {tuple(r.tokens) for r in spark.read.parquet(f"{tmp_path}/shards").collect()} == {(0, 5 + k, 0, 0, 0, 0) for k in range(5)}
