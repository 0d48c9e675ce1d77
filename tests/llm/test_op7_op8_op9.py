import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from grainmill.llm import components as K
from grainmill.llm import containment as B
from grainmill.llm import mixing as X
from grainmill.llm import simhash_pivots as S

SF = "/root/testdata/sf0.001"


def grams(text, n):
    w = B.words(text)
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = []
    for i, t in items:
        n = min(5, len(B.words(t)))
        own = grams(t, n) if n else set()
        for d, text in docs:
            shared = len(own & grams(text, n)) if n else 0
            if own and 5 * shared >= 4 * len(own):
                out.append(str((d, i, shared, len(own))))
    return sorted(out)


def test_containment_equals_brute_force(spark, odd, monkeypatch):
    random.seed(6)
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + [(r.doc_id, r.text) for r in odd.collect()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()] + [(900, None), (901, ""), (902, "Words"), (None, "two lines"), (903, "!!")]
    for k, (_, text) in enumerate(items[:30]):
        w = text.split()
        for broken in (0, 1, 2, 5):
            v = list(w)
            for at in random.sample(range(len(v)), min(broken, len(v))):
                v[at] = "changed"
            docs.append((5000 + 10 * k + broken, f"before. {' '.join(v).upper()}, after" + " tail" * random.randrange(3000)))
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    got = lambda: sorted(str((r.doc_id, r.item_id, r.n_shared, r.n_shingles)) for r in B.find(*frames).collect())
    assert got() == want
    # beyond the size of an index: signatures are joined; in blocks
    monkeypatch.setattr(B, "BLOCK_BYTES", 0)
    assert got() == want
    monkeypatch.setattr(B, "SIGNATURES", 100)
    assert got() == want


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(str, B.find(docs, items).collect()))
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)
    assert sorted(map(str, B.find(docs, items).collect())) == want
    kept = B.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({w.split("doc_id=")[1].split(",")[0] for w in want})


@pytest.mark.parametrize("block", [4 << 20, 0])
def test_containment_of_odd_tables(spark, odd, none, clash, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(1, "two lines and more of them")], "item_id bigint, text string")
    assert {r.doc_id for r in B.find(odd, items).collect()} == {1}
    assert B.find(none, items).count() == 0 and B.find(odd, items.limit(0)).count() == 0
    assert B.decontaminated(clash, items).count() == clash.count() - 2 and B.decontaminated(clash, items).columns == clash.columns
    assert B.decontaminated(none, items).count() == 0 and B.decontaminated(odd, items.limit(0)).count() == odd.count()


def water(sizes, weights):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_follows_targets(spark):
    random.seed(8)
    rows = [(k, "w " * random.randrange(0, 50), random.choice([None, "", "a", "b", "c", "d", "e"]) if k % 3 else "hot") for k in range(900)]
    rows += [(k, None, "f") for k in range(3)] + [rows[5], rows[5]] + [(None, "no id here", "a")]
    out = X.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), carry=True).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.row.source] += r["size"]
        taken[r.row.source] += r.taken
        assert r["size"] == len((r.row.text or "").split()) and 0 <= r.taken <= 3 * r["size"]
    want = water(sizes, (5, 2, 1))
    for r in out:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    again = X.mix(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string").repartition(5)).collect()
    key = lambda r: str((r.doc_id, r["size"], r.source_size, r.taken))
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_mix_of_odd_tables(odd, none, clash):
    assert X.mix(none).count() == 0 and X.mix(odd).count() == odd.count()
    out = X.mixed(clash)
    assert out.columns == clash.columns and out.where("text is null").count() == 0
    empty = odd.where("text is null")
    assert {(r.target, r.taken) for r in X.mix(empty).collect()} == {(0.0, 0)}


def test_fingerprints():
    import xxhash

    text = "The quick BROWN fox\tjumps over É the lazy dog " * 3
    words = text.encode().lower().split()
    votes = [0] * 64
    n = len(words) - 3
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    assert S.fingerprint(text) == sum(1 << b for b in range(64) if 2 * votes[b] > n)
    assert S.fingerprint("Two Words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


def test_blocks_let_every_link_meet():
    random.seed(9)
    for nodes in (10, 10**6, 10**8, 10**11):
        plan = S.block_plan(nodes, 4)
        for _ in range(300):
            flipped = sum(1 << b for b in random.sample(range(64), 4))
            assert any(all(not flipped >> shift & (1 << width) - 1 for shift, width in key) for key in plan)


def groups(rows, radius=4):
    fps, ids = np.array([S.fingerprint(t) for _, t in rows], np.uint64), [i for i, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius):
            parent[find(i)] = find(int(j))
        for j in range(i):
            if ids[i] is not None and ids[i] == ids[j]:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(str((ids[i], f"{int(fps[i]):016x}", least.get(find(i)))) for i in range(len(rows)))


def near_rows():
    random.seed(3)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    for k, (_, text) in enumerate([r for r in rows if len(r[1]) > 2500][:3]):
        for j in range(150):
            words = text.split(" ")
            for _ in range(random.randrange(4)):
                words[random.randrange(len(words))] = f"new{random.randrange(9)}"
            rows.append((10_000 + 1000 * k + j, " ".join(words)))
    return rows + [(5, "other words"), (None, rows[3][1]), (None, "words of its own"), (20_000, None), (20_001, ""), (20_002, " . ")]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = groups(rows)
    got = lambda: sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in S.near_duplicates(df).collect())
    assert got() == want
    monkeypatch.setattr(S, "HOT", 40)  # chunks of hot partitions give the same
    assert got() == want


def plain_wide(text, prints=4, keys=3):
    """Votes counted bit by bit; the least shingle under each hash function."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]

    def other(h, n):
        if n:
            h = (h * (0x9E3779B97F4A7C15 + 2 * n) + n) % 2**64
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
            h ^= h >> 31
        return h

    own = [[other(h, n) for h in hashes] for n in range(prints)]
    fps = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in own]
    return fps, [min((other(h, 100 + n) for h in hashes), default=-1) for n in range(keys)]


def classes(rows, limit):
    """All pairs: the smallest id of each id's class."""
    wide, ids, parent = [plain_wide(t) for _, t in rows], [i for i, _ in rows], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (fps, least) in enumerate(wide):
        for j in range(k):
            other, others = wide[j]
            if ids[k] is not None and ids[j] is not None and any(x == y for x, y in zip(least, others, strict=True)) and sum((x ^ y).bit_count() for x, y in zip(fps, other, strict=True)) <= limit:
                a, b = sorted((find(ids[k]), find(ids[j])))
                parent[b] = a
    return {i: find(i) for i in ids if i is not None}


def some_rows():
    random.seed(4)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:90]
    for k, (_, text) in enumerate([r for r in rows if 400 < len(r[1]) < 4000][:4]):
        for j in range(25):
            words = text.split(" ")
            for _ in range(random.randrange(1 + len(words) // 30)):
                words[random.randrange(len(words))] = f"new{random.randrange(9)}"
            rows.append((10_000 + 1000 * k + j, " ".join(words)))
    return rows + [(5, "other words"), (None, rows[3][1]), (None, "words of its own"), (20_000, None), (20_001, ""), (20_002, " . "), (20_003, "OTHER  words")]


def test_wide_fingerprints():
    for text in ("The quick BROWN fox\tjumps over É the lazy dog " * 3, "Two Words", "x " * 3000, None, " \n"):
        fps, least = S.wide_fingerprint(text, 5, 42, 4, 3)
        want = plain_wide(text)
        assert fps.tolist() == want[0] and (least.tolist() == want[1] or want[1] == [-1] * 3)
    assert S.wide_fingerprint("a b c d e f", 4, 42, 1)[0][0] == S.fingerprint("a b c d e f")


def test_similar_documents_equal_brute_force(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = classes(rows, S.bit_limit(0.8, 4))
    got = lambda: {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    assert got() == want and len(set(want.values())) < len(want) - 30
    monkeypatch.setattr(S, "HOT", 40)  # chunks of hot partitions give the same
    assert got() == want


def test_recall_of_similar_texts(spark):
    """Pairs whose five-word shingles have a Jaccard similarity of 0.8 or more are found in nine cases of ten; of half as similar ones, one in a hundred at most."""
    random.seed(11)
    rows, similarity = [], {}
    for k in range(600):
        words = [f"w{random.randrange(3000)}" for _ in range(random.choice((60, 200, 600)))]
        copy = list(words)
        for _ in range(max(1, round(len(words) * random.choice((0.005, 0.012, 0.02, 0.1))))):
            copy[random.randrange(len(copy))] = f"n{random.random()}"
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (words, copy))
        similarity[k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    found = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near, far = ([found[2 * k + 1] == 2 * k for k, s in similarity.items() if lo <= s < hi] for lo, hi in ((0.8, 2), (0, 0.55)))
    assert len(near) > 200 and np.mean(near) >= 0.9 and len(far) > 100 and np.mean(far) <= 0.01
    assert all(v in (i, i - 1) for i, v in found.items())


@pytest.mark.parametrize("size", [32 << 20, 0])
def test_one_of_each(spark, odd, clash, none, monkeypatch, size):
    monkeypatch.setattr(S, "BROADCAST_BYTES", size)
    rows = some_rows()
    out = S.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    kept = [r.doc_id for r in out.collect()]
    want = set(classes(rows, S.bit_limit(0.8, 4)).values())
    assert {k for k in kept if k is not None} == want and len(kept) == len(want) + 2
    assert S.one_of_each(clash).columns == clash.columns and S.near_duplicates(none).count() == 0
    more = clash.toDF(*clash.columns[:-3], "gone", "c0", "c1")
    assert S.one_of_each(more).columns == more.columns
    ids = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert ids(S.one_of_each(more)) == ids(S.one_of_each(odd)) and S.one_of_each(none).count() == 0
    plain = lambda df: sorted(map(str, S.near_duplicates(df).collect()))
    assert plain(clash) == plain(odd)


def test_pivots_discard_before_the_distance(spark):
    """Of the pairs that meet under a block key, the table leaves few; it loses no link."""
    fps = np.array([[S.fingerprint(t)] for t in {r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}], np.uint64)
    table = S.pivot_table(fps, S.pivot_fingerprints())
    i, j = np.triu_indices(len(fps), 1)
    a, b = S.left_by_pivots(table, i, j, 4)
    left = set(zip(a.tolist(), b.tolist(), strict=True))
    near = np.bitwise_count(fps[i, 0] ^ fps[j, 0]) <= 4
    assert set(zip(i[near].tolist(), j[near].tolist(), strict=True)) <= left and len(left) < len(i) / 1000


def test_components_of_chains(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    random.shuffle(edges)
    got = {r.node: r.component for r in K.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}
    assert K.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
