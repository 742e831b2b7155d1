"""Saved indexes: recall of vectors against brute force, text scores against the scan."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.operators import kept_index, near, search, vector_index
from orrery.sources.tables import table


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall_of(rows, x, keys, queries, k):
    got = {}
    for r in rows:
        got.setdefault(r["query"], []).append((r["rank"], r["key"], r["score"]))
    hits = 0
    for q in queries:
        score = x @ x[keys.index(q)]
        best = sorted(range(len(x)), key=lambda i: (-score[i], keys[i]))[:k]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, k + 1))
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        for _, key, s in own:
            assert s == pytest.approx(score[keys.index(key)], abs=1e-5)
        hits += len({keys[i] for i in best} & {key for _, key, _ in own})
    return hits / (k * len(queries))


def test_vector_index_recall(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    own = e.collect()
    index = vector_index.build(e, "vec_id", "embedding")
    assert index.read().count() == len(own) == index.held().sum()
    rows = vector_index.search(index, e.where("vec_id % 20 = 0"), "vec_id", "embedding").collect()
    keys = [r["vec_id"] for r in own]
    recall = recall_of(rows, unit(np.array([r["embedding"] for r in own])), keys, [k for k in keys if k % 20 == 0], 10)
    assert recall >= 0.9, recall


def test_vector_index_reads_few_cells_of_clustered_vectors_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    x = np.concatenate([middle[i % 40] + 0.1 * rng.normal(size=16) for i in range(1600)]).reshape(1600, 16)
    x[:500] = x[0]  # a third of the rows are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = vector_index.build(df, "id", "v", sample=600)
    assert index.probes <= len(index.centroids) / 4
    queries = df.where("id % 20 = 0")
    plain = vector_index.search(index, queries, "id", "v", 5).collect()
    assert recall_of(plain, unit(x.astype(np.float32)), list(range(1600)), range(500, 1600, 20), 5) >= 0.9
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(vector_index, "QUERY_BYTES", 0)  # many queries are shuffled with the rows
    cut = vector_index.search(index, queries, "id", "v", 5).collect()
    key = lambda r: (r["query"], r["rank"], round(r["score"], 5))
    assert sorted(map(key, plain)) == sorted(map(key, cut))


def test_vector_index_odd_rows(spark):
    schema = "id string, v array<float>"
    empty = vector_index.build(spark.createDataFrame([], schema), "id", "v")
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [0.0, None])], schema)
    assert vector_index.search(empty, some, "id", "v").collect() == []
    index = vector_index.build(some, "id", "v")
    got = vector_index.search(index, some.where("id IN ('a', 'c')"), "id", "v", 3, probes=99).collect()
    assert [(r["query"], r["key"], r["score"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", "a", 1.0, 1), ("a", "b", 1.0, 2), ("a", "d", 0.0, 3)]


def test_vector_index_after_changes(spark):
    rng = np.random.default_rng(6)
    x = {i: rng.normal(size=8).astype(np.float32) for i in range(300)}
    frame = lambda d: spark.createDataFrame([(i, [float(e) for e in v]) for i, v in d.items()], "id long, v array<float>")
    built = vector_index.build(frame(x), "id", "v")
    changed = {i: rng.normal(size=8).astype(np.float32) for i in [*range(0, 40), *range(300, 330)]}
    now = built.refresh(frame(changed), frame({i: x[i] for i in range(100, 150)}))
    now = now.refresh(frame({120: x[120]}), frame(x).limit(0))  # one comes back
    state = {i: v for i, v in x.items() if not 100 <= i < 150 or i == 120} | changed
    assert {r.id for r in now.read().collect()} == set(state)
    keys, asked = sorted(state), frame({i: state[i] for i in (0, 120, 305, 200)})
    m = np.stack([state[i] for i in keys])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for index in (now, vector_index.opened(spark, now.root), now.compact(), vector_index.opened(spark, now.root)):
        got = vector_index.search(index, asked, "id", "v", 3, probes=99).collect()
        assert recall_of(got, m, keys, [0, 120, 305, 200], 3) == 1
    assert {r.id for r in vector_index.opened(spark, now.root, 1).read().collect()} == set(x)  # the first version is still there


def test_vector_search_reads_the_probed_cells(spark):
    x = np.concatenate([np.eye(12)[i % 12] + 0.01 * np.random.default_rng(i).normal(size=12) for i in range(600)]).reshape(600, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = vector_index.build(df, "id", "v")
    plan = vector_index.search(index, df.where("id = 5"), "id", "v", 5)._jdf.queryExecution().toString()
    assert any("PartitionFilters: [cell" in line or "cell#" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in plan.splitlines() if "FileScan" in line and "PartitionFilters:" in line)
    assert "FlatMapCoGroups" not in plan


def shuffled(spark, df):
    """Records that a query's stages hand to shuffles."""
    context, group = spark.sparkContext, f"shuffled-{id(df)}"
    context.setJobGroup(group, group)
    df.collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_vector_search_gives_the_best_of_a_task_or_block_not_of_each_cell(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(1600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index, queries, given, by_map = vector_index.build(df, "id", "v"), df.where("id % 20 = 0"), [], vector_index._by_map
    assert len(index.centroids) == 40
    monkeypatch.setattr(vector_index, "_by_map", lambda *a: given.append(by_map(*a)) or given[-1])
    plain = vector_index.search(index, queries, "id", "v", 5, probes=40).collect()
    assert recall_of(plain, unit(x), list(range(1600)), range(0, 1600, 20), 5) == 1
    assert given[0].rdd.getNumPartitions() < 20
    assert given[0].count() <= 80 * 5 * given[0].rdd.getNumPartitions()
    monkeypatch.setattr(vector_index, "QUERY_BYTES", 0)
    found = vector_index.search(index, queries, "id", "v", 5, probes=40)
    assert shuffled(spark, found) <= 1600 + 80 + 80 * 5  # all cells are one block: rows and queries once each, then the best
    assert sorted(found.collect()) == sorted(plain)


def test_vector_search_ranks_equal_rows_by_key_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 7)).astype(np.float32)
    base[40:] = 0
    base[40:, 0] = rng.integers(1, 9, 20)  # the same direction
    base[50:55] = 0  # no direction: all rows score 0
    x = base[rng.integers(0, 60, 900)]
    keys = [f"k{i}" for i in rng.permutation(900)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], "id string, v array<float>")
    index = vector_index.build(df, "id", "v")
    asked = sorted(keys)[::9]
    unit_x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-30))
    want = set()
    for q in asked:
        score = np.einsum("ij,j->i", unit_x, unit_x[keys.index(q)], dtype=np.float64).round(6)
        want |= {(q, keys[i], r + 1) for r, i in enumerate(sorted(range(900), key=lambda i: (-score[i], keys[i]))[:7])}
    for rows, lot, limit in ((1 << 14, 1 << 14, 32 << 20), (50, 7, 0), (1 << 14, 30, 0)):
        for name, value in {"BLOCK_ROWS": rows, "BLOCK_QUERIES": lot, "QUERY_BYTES": limit}.items():
            monkeypatch.setattr(vector_index, name, value)
        got = vector_index.search(index, df.where(F.col("id").isin(asked)), "id", "v", 7, probes=99).collect()
        assert {(r["query"], r["key"], r["rank"]) for r in got} == want


def test_vector_index_of_a_sample_is_the_same_each_time(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(900, 4)))], "id long, v array<double>")
    one, two = (vector_index.build(df, "id", "v", sample=200) for _ in range(2))
    assert np.array_equal(one.centroids, two.centroids) and one.probes == two.probes


def test_vector_search_takes_a_null_key_first_of_equal_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, None, 2)], "id long, v array<double>")
    index = vector_index.build(df, "id", "v")
    for limit in (32 << 20, 0):
        monkeypatch.setattr(vector_index, "QUERY_BYTES", limit)
        got = vector_index.search(index, df.where("id = 3"), "id", "v", 2).collect()
        assert [(r["key"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(None, 1), (1, 2)]


@pytest.mark.parametrize("scores", [1, 700, 1 << 20])
def test_best_rows_come_whole_from_any_cells_and_batches(monkeypatch, scores):
    monkeypatch.setattr(vector_index, "SCORES", scores)
    monkeypatch.setattr(vector_index, "FINDS", min(scores, 50))
    rng = np.random.default_rng(10)
    q, v, cell = unit(rng.normal(size=(23, 5)).astype(np.float32)), unit(rng.normal(size=(400, 5)).astype(np.float32)), rng.integers(0, 11, 400)
    v[200:] = v[:200]  # each row twice, in cells of their own
    probed = rng.random((23, 11)) < 0.5
    probed[4] = False
    best = vector_index.Best(q, [m.tobytes() for m in np.packbits(probed, axis=1)], 6)
    rows = pd.DataFrame({"key": rng.permutation(400), "v": list(v), "cell": cell})
    for a in range(0, 400, 90):
        best.add(rows[a : a + 90])
    got = pd.concat(best.rows(np.arange(23)))
    for i in range(23):
        own = [j for j in range(400) if probed[i, cell[j]]]
        score = np.einsum("ij,j->i", v, q[i], dtype=np.float64).round(9)
        want = sorted(own, key=lambda j: (-score[j], rows.key[j]))[:6]
        assert got[got["query"] == i].key.tolist() == rows.key[want].tolist()


def kept_on(spark, tmp_path, rows, columns=None, schema="id long, text string"):
    index = kept_index.KeptIndex(spark, f"{tmp_path}/index")
    docs = spark.createDataFrame(rows, schema)
    index.build(docs, "id", columns or {"title": "text"})
    return index, docs


def scores(df):
    return {r["key"]: r["score"] for r in df.collect()}


def scanned(docs, terms):
    return {r["id"]: r["score"] for r in search.bm25(docs, terms, "id", "text").collect()}


ROWS = [(1, "red ring, Red"), (2, None), (3, ""), (4, "ring " * 3000 + "blue"), (5, "red"), (6, "reds ringing"), (7, "...")]


def test_kept_index_gives_the_scores_of_the_scan(spark, tmp_path):
    index, docs = kept_on(spark, tmp_path, ROWS)
    for terms in (["red"], ["red", "ring"], ["red", "red"], ["absent"], ["a b"]):
        assert scores(index.bm25(terms)) == pytest.approx(scanned(docs, terms)), terms
    assert index.bm25([]).collect() == []
    empty, _ = kept_on(spark, tmp_path / "none", [])
    assert empty.bm25(["red"]).collect() == [] == empty.fuzzy("red", 5).collect() == empty.prefix("re", 5).collect()


def test_kept_index_reads_the_folders_of_its_terms(spark, tmp_path):
    index, _ = kept_on(spark, tmp_path, [(i, f"w{i} common") for i in range(200)])
    for found in (index.bm25(["w7"]), index.fuzzy("w7", 3, 1), index.prefix("w19", 3)):
        plan = found._jdf.queryExecution().toString()
        filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "FileScan" in line and ("at#" in line or "h#" in line)]
        assert filters and all("PartitionFilters: [isnotnull(bucket" in f or "PartitionFilters: [bucket" in f or "IN (" in f for f in filters)
        assert "text#" not in plan


def test_kept_index_after_changes_is_as_built_anew(spark, tmp_path):
    index, _ = kept_on(spark, tmp_path, ROWS)
    state = dict(ROWS)
    rng = np.random.default_rng(5)
    for step in range(12):
        changed = {int(k): " ".join(rng.choice(["red", "ring", "blue", "reds"], 3)) for k in rng.integers(1, 12, 3)}
        removed = [int(k) for k in rng.integers(1, 12, 2)]
        state = {k: v for k, v in state.items() if k not in removed} | changed
        now = spark.createDataFrame(sorted(state.items()), "id long, text string")
        how = index.refresh(spark.createDataFrame(list(changed.items()), "id long, text string"), spark.createDataFrame([(k,) for k in removed], "id long"), "id", {"title": "text"}, now)
        assert how == "delta"
        m = index.manifest()
        assert len(m.segments) <= kept_index.MAX_SEGMENTS and m.rows == len(state)
        if step % 4 == 3:
            for terms in (["red"], ["blue", "ring"]):
                assert scores(index.bm25(terms)) == pytest.approx(scanned(now, terms)), (step, terms)
    old, before = index.manifest(3), index.manifest()
    assert old.version == 3 and old.segments != before.segments
    index.compact()
    index.vacuum()
    assert index.manifest().dead == 0 and len(index.manifest().segments) == 1
    assert scores(index.bm25(["red"])) == pytest.approx(scanned(now, ["red"]))
    nothing = now.limit(0)
    assert index.refresh(nothing, nothing, "id", {"title": "text"}, now) == "noop"
    assert index.refresh(now, nothing, "id", {"title": "text"}, now, rebuild_at=len(state)) == "full"
    assert scores(index.bm25(["red"])) == pytest.approx(scanned(now, ["red"]))


def test_two_writers_cannot_make_the_same_version(spark, tmp_path):
    index, _ = kept_on(spark, tmp_path, ROWS)
    m = index.manifest()
    index._commit(m)
    with pytest.raises(Exception, match="[Ee]xist"):
        index._commit(m)


def test_near_terms_and_phrases(spark, tmp_path):
    rows = [(1, "the red ring", "gold"), (2, "the reed", "red"), (3, "rde ring", None), (4, None, "redd"), (5, "the redder the ring", ""), (6, "x" * 60, "r")]
    index, _ = kept_on(spark, tmp_path, rows, {"title": "text", "namespace": "kind"}, "id long, text string, kind string")
    got = [tuple(r) for r in index.fuzzy("red", 10, max_distance=1).collect()]
    assert got == [(1, 1.0, 0, "title", "red"), (2, 0.92, 0, "namespace", "red"), (4, pytest.approx(0.69), 1, "namespace", "redd")]
    swapped = [r["key"] for r in index.fuzzy("red", 10, max_distance=1, transposition=True).collect()]
    assert swapped == [1, 2, 4, 3]
    assert [r["key"] for r in index.fuzzy("eed", 10, max_distance=2, prefix=1).collect()] == []
    assert scores(index.prefix("the re", 10)) == {1: 5.0, 2: 5.0, 5: 5.0}
    assert scores(index.prefix("the redder the ri", 10)) == {5: 5.0}
    assert scores(index.prefix("red", 10)) == {1: 5.0, 2: 3.5, 4: 3.5, 5: 5.0}
    assert index.prefix(" ", 3).collect() == []


def test_an_index_is_built_once_for_a_table(spark, tmp_path, monkeypatch):
    spark.createDataFrame(ROWS, "id long, text string").write.parquet(f"{tmp_path}/t.parquet")
    docs = spark.read.parquet(f"{tmp_path}/t.parquet")
    first = kept_index.kept(docs, "t", "id", {"title": "text"})
    monkeypatch.setattr(kept_index.KeptIndex, "build", None)
    assert kept_index.kept(docs, "t", "id", {"title": "text"}).root == first.root


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_similar_names_and_their_groups(spark):
    rng = random.Random(1)
    names = set()
    for _ in range(40):
        names.add(base := "".join(rng.choice("abc") for _ in range(rng.randint(1, 70))))
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(s) + 1)
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ab"])
            names.add("".join(s))
    names |= {f"Customer#{i:09d}" for i in range(0, 400, 7)}
    names = sorted(names - {""})
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,), ("",)], "name string")
    for least in (0.94, 0.8, 1.0):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 1 - plain_distance(a, b) / max(len(a), len(b)) >= least - 1e-9}
        got = [(r.left_name, r.right_name) for r in near.similar_pairs(df, "name", least).collect()]
        assert len(got) == len(want) and set(got) == want
        order = rng.sample(names, len(names))
        alike, leader = defaultdict(set), {}
        for a, b in want:
            alike[a].add(b)
            alike[b].add(a)
        for n in order:
            if n not in leader:
                leader |= {n: n} | {m: n for m in alike[n] if m not in leader}
        at = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, at int")
        pairs = spark.createDataFrame(sorted(want), "left_name string, right_name string")
        assert dict(near.greedy_groups(at, pairs).select("name", "leader").collect()) == leader
    with pytest.raises(ValueError):
        near.similar_pairs(df, "name", 0.5)


def test_keys_of_names_are_not_broadcast(spark):
    names = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(50)] + [("x" * 60,)], "name string")
    plan = near.similar_pairs(names, "name", 0.94)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_groups_are_not_broadcast(spark):
    at = spark.createDataFrame([(f"n{i}", i) for i in range(9)], "name string, at int")
    pairs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)], "left_name string, right_name string")
    found = near.greedy_groups(at, pairs)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(found.collect()) == {"n0": "n0", "n1": "n0", "n2": "n2", "n3": "n2", "n4": "n4", "n5": "n4", "n6": "n6", "n7": "n6", "n8": "n8"}


def test_postings_are_read_in_lists_and_in_order():
    """Packed rows become postings chunk by chunk, sorted, so Spark's sort merges runs; nothing is exploded row by row."""
    packed = pa.table({"key": [7, 8], "field": ["f", "f"], "dl": pa.array([5, 2], pa.int32()), "bucket": pa.array([1, 0], pa.int32()), "text": ["b 0,10\na 1", "c 3,4,5"]})
    assert [r for b in kept_index.unpacker(iter(packed.to_batches())) for r in b.to_pylist()] == [
        {"key": 8, "field": "f", "term": "c", "at": [3, 4, 5], "dl": 2, "bucket": 0},
        {"key": 7, "field": "f", "term": "a", "at": [1], "dl": 5, "bucket": 1},
        {"key": 7, "field": "f", "term": "b", "at": [0, 10], "dl": 5, "bucket": 1},
    ]
    assert list(kept_index.unpacker(iter([]))) == []


def test_a_phrase_is_met_by_lists_of_places(spark, tmp_path):
    texts = ["of the of then of of thin", "the of", None, "of th" + " of the" * 300, "so of the"]
    index = kept_index.KeptIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", {"text": "text"})
    assert [tuple(r) for r in index.prefix("of th", 9).collect()] == [(3, 1505.0), (0, 15.0), (4, 5.0)]
    assert [tuple(r) for r in index.prefix("so of th", 9).collect()] == [(4, 5.0)]
    assert index.prefix("of zz", 9).collect() == []
    plan = index.prefix("of th", 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # a row for each place went through the shuffle before
