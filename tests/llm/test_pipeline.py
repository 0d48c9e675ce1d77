import struct
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    """Each stage against a plain version of it, on the rows that the plain version of the stage before kept; only the language model is the fitted one."""
    import corpus_pipeline as P
    from test_op2_op3 import plain_prediction
    from test_op7_op8_op9 import brute, classes
    from tokenizers import Tokenizer

    from grainmill.llm import language_id, mixing, simhash_pivots
    from grainmill.llm.queries import vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, steps = docs.collect(), {}
    model = language_id.fit(docs)
    rows = steps["language"] = [r for r in rows if any(c.isalpha() for c in r.text or "") and plain_prediction(model, r.text)[2] <= 0]
    kept = classes([(r.doc_id, r.text) for r in rows], simhash_pivots.bit_limit(0.8, 4))
    rows = steps["near_duplicates"] = [r for r in rows if kept[r.doc_id] == r.doc_id]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    held = {int(b.split(",")[0].lstrip("(")) for b in brute([(r.doc_id, r.text) for r in rows], items)}
    rows = steps["decontamination"] = [r for r in rows if r.doc_id not in held]
    assert 0 < len(held) and len(rows) > 100
    documents = spark.createDataFrame(rows, docs.schema).toPandas()  # noqa: F841
    mixed = duckdb.sql(mixing.ORACLE.replace("FROM documents", "FROM documents")).fetchall()
    times = {m[0]: int((2 * m[4] + m[1]) // (2 * m[1])) if m[1] else 0 for m in mixed}
    rows = steps["mixture"] = [r for r in rows for _ in range(times[r.doc_id])]
    library, start, want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = P.run(spark, SF).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "token_output"]
    step = docs
    for name, stage in P.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns and sorted(r.doc_id for r in step.collect()) == sorted(r.doc_id for r in steps[name])


@pytest.mark.parametrize("kind", ["odd", "none", "clash"])
def test_stages_on_odd_tables(spark, request, kind):
    import corpus_pipeline as P

    docs = request.getfixturevalue(kind)
    rows = {name: stage(spark, docs, SF) for name, stage in P.STAGES}
    assert all(rows[n].columns == docs.columns for n in rows if n != "token_output")
    if kind == "none":
        assert not any(r.count() for r in rows.values())
        return
    size = docs.count()
    found = {n: [(r.doc_id, r.text) for r in df.collect()] for n, df in rows.items() if n != "token_output"}
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in found["language"])
    # of the ids 1 (three rows), 7 and 9 (equal texts), 3, 4, 5 (wordless); without an id both rows stay
    assert sorted(i or 0 for i, _ in found["near_duplicates"]) == [0, 0, 1, 3, 6, 7, 8]
    assert len(found["decontamination"]) == size and not any(t is None or not t.strip() for _, t in found["mixture"])
    assert rows["token_output"].count() == size
    step = docs
    for _, stage in P.STAGES:
        step = stage(spark, step, SF)
    assert step.count() > 0


def test_stages_leave_no_tables_behind(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    from grainmill.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = common.settled(spark, lambda: P.near_duplicates(spark, docs, SF), "kept")
    assert len(list((tmp_path / "grainmill").iterdir())) == 1 and 0 < kept.count() < docs.count()
    common.cleanup(spark)
    assert not list((tmp_path / "grainmill").iterdir())


def test_a_folder_of_our_own_only_on_one_machine():
    from grainmill.llm import common

    assert common._own_dir("local[4]") == common._own_dir("local[4]")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common._own_dir(master)
