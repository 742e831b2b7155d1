"""Operators that SQL can't express, and refusals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import intents
from orrery.functions import markdown as md
from orrery.operators import entities, graph, projection, state, surface
from orrery.plans import states
from orrery.sources.shared import Saved
from orrery.streaming import windows

NOTE = """---
title: "A note"
---
intro

# One
:PROPERTIES:
:ID: x1
:END:
text of one
## Two
- item
```
# not a heading
```
:LOGBOOK:
- [2024-01-01] done
:END:
# Three
"""


def test_sections():
    front, body = md.split_front_matter(NOTE)
    assert front == 'title: "A note"'
    got = md.sections(body)
    assert [(s.path, s.level) for s in got] == [("", 0), ("One", 1), ("One / Two", 2), ("Three", 1)]
    assert md.attributes(got[1].lines) == {"ID": "x1"}
    assert md.log_entries(got[2].lines, got[2].start) == [("2024-01-01", "done", got[2].start + 6)]
    assert "# not a heading" in got[2].body
    assert md.sections("") == []


def test_section_table_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, NOTE)], "k int, note string")
    rows = md.section_table(df, "k", "note").collect()
    assert {r["k"] for r in rows} == {3} and len(rows) == 4
    assert df.select(md.front_value(F.col("note"), "title").alias("t")).where("t IS NOT NULL").collect()[0]["t"] == "A note"


def test_page_tree():
    long = "word " * 20
    whole = md.page_tree(f"# A\n{long}\n## B\nshort\n### C\n{long}\n# D\n", 12)
    assert [(n[2], n[1], n[6]) for n in whole] == [("A", -1, False), ("B", 0, True), ("D", -1, False)]
    assert whole[1][5] == 1 + 1 + 20
    assert [n[2] for n in md.page_tree("# A\n## B\n# C", 1)] == ["A", "C"]


def test_page_index_query(spark):
    sf = "/root/testdata/sf0.001"
    notes = states._notes(spark, sf).collect()
    want = sorted((r["item_id"], *n) for r in notes for n in md.page_tree(r["note"], 40))
    assert sorted(map(tuple, states.markdown_page_index(spark, sf).collect())) == want


def test_dense_clusters_by_component(spark):
    rng = random.Random(3)
    score, out = {}, {}
    for part in range(4):
        names = [f"{part}-{i}" for i in range(12)]
        score |= {n: round(rng.random() + 0.5, 3) for n in names}
        for a in names:
            out[a] = {b for b in names if b != a and rng.random() < 0.6}
    want = sorted((c[0], c[1:]) for c, _, _ in graph.grow_clusters({n: s for n, s in score.items() if s >= 0.7}, {a: {b for b in ends if score[b] >= 0.7} for a, ends in out.items() if score[a] >= 0.7}))
    nodes = spark.createDataFrame([(n, s, 3) for n, s in score.items()] + [("rare", 1.4, 2)], "node string, score double, activations int")
    edges = spark.createDataFrame([(a, b) for a, ends in out.items() for b in ends] + [("rare", "0-1")], "src string, dst string")
    got = graph.dense_clusters(nodes, edges, 0.7).collect()
    assert sorted((r["members"][0], r["members"][1:]) for r in got) == want and want
    assert all(r["density"] >= graph.LEAST_DENSITY for r in got)


def test_labels_of_a_path(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "src string, dst string")
    got = {r["node"]: r["label"] for r in graph.labels(e).collect()}
    assert set(got.values()) == {"n00", "x"} and len(got) == 23


def test_ordered_fold_in_ranges(spark):
    rng = random.Random(1)
    rows = [(k, i * 3 + k, rng.uniform(-2, 3)) for k in range(3) for i in range(200 if k else 1)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(5)
    got = {r["k"]: (r["state"], r["n"]) for r in state.ordered_fold(df, "k", "i", F.lit(0.9), F.col("v"), 0.0, 2.0, 1.0, rows=16).collect()}
    for k in range(3):
        x = 1.0
        mine = sorted(r for r in rows if r[0] == k)
        for _, _, v in mine:
            x = min(max(0.9 * x + v, 0.0), 2.0)
        assert math.isclose(got[k][0], x, abs_tol=1e-9) and got[k][1] == len(mine)


def test_gate_has_each_verdict(spark):
    df = spark.createDataFrame([(1, 20, 18, 0, "ok", 1.0), (2, 5, 0, 5, "error", 0.0), (3, 1, 0, 0, "ok", 0.5)], "id int, n int, s int, f int, o string, q double")
    q = F.col("q")
    got = state.gate(state.ledger(df, F.col("n"), F.col("s"), F.col("f"), F.col("o"), q, q, q, q)).orderBy("id").collect()
    assert [r["verdict"] for r in got] == ["promote", "obsolete", "retain"]
    assert all(0 <= r["confidence"] <= 1 for r in got)
    assert got[1]["failure_rate"] == 1.0


@pytest.mark.parametrize("sql", ["", "SELECT 1; SELECT 2", "DROP TABLE x", "INSERT INTO x SELECT 1", "CREATE TABLE x AS SELECT 1", "SET a = 1", "not sql", "SHOW TABLES", "DELETE FROM x", "CREATE OR REPLACE TEMP VIEW v AS SELECT 1"])
def test_only_queries_pass(spark, sql):
    with pytest.raises(ValueError):
        surface.check_read_only(spark, sql)


def test_queries_pass(spark):
    for sql in ("SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a ORDER BY x LIMIT 1", "SELECT a.x FROM a JOIN b ON a.x = b.x UNION ALL SELECT 2", "VALUES (1)"):
        surface.check_read_only(spark, sql)


def test_author_refuses(spark):
    t = {"t": spark.createDataFrame([(1, "a%b"), (2, None)], "i int, s string")}
    bad = [surface.Spec("u", ["i"], 1), surface.Spec("t", ["*"], 1), surface.Spec("t", [], 1), surface.Spec("t", ["x"], 1), surface.Spec("t", ["i"], 0), surface.Spec("t", ["i"], 101), surface.Spec("t", ["i"], 1, [("i", "contains", "1")]), surface.Spec("t", ["i"], 1, [("i", "gt", "1")]), surface.Spec("t", ["i"], 1, [], [("i", "up")])]
    for spec in bad:
        with pytest.raises(ValueError):
            surface.author(t, spec)
    with pytest.raises(ValueError):
        surface.author(t, surface.Spec("t", ["i"], 1), surface.Policy(needs_filter=frozenset({"t"})))
    assert surface.author(t, surface.Spec("t", ["i"], 5, [("i", "eq", "2")])).collect()[0]["i"] == 2


def test_multi_hop_stops_short(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    for hops, want in [(0, set()), (1, {"a"}), (2, {"a", "b"}), (3, {"a", "b", "c"})]:
        assert {r["node"] for r in entities.multi_hop(e, start, hops).collect()} == want


def test_tool_relevance_walks(spark):
    ents = spark.createDataFrame([("git", ["vcs"], "Concept"), ("commit", None, "Tool"), ("push", None, "Tool"), ("far", None, "Tool")], "name string, aliases array<string>, entity_type string")
    rel = spark.createDataFrame([("git", "commit", "Contains"), ("push", "git", "Uses"), ("commit", "far", "Uses")], "src string, dst string, kind string")
    got = {r["node"]: round(r["score"], 6) for r in entities.tool_relevance(ents, rel, ["vcs"], 3, 10).collect()}
    assert got == {"commit": round((0.85 + 0.2) * 0.5, 6), "push": round(0.85 * 0.5, 6), "far": round((0.85 + 0.2) * 0.5 * 0.25, 6)}


def test_tiers(spark):
    some, none = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([], "i int")
    assert [r["i"] for r in projection.tiered(none, some).collect()] == [1]
    assert projection.tiered(none, none).collect() == []


def test_late_rows_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    for i, hours in enumerate([[0, 1, 9], [0, 10, 20]]):
        spark.createDataFrame([(h,) for h in hours], "h int").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(str(src / f"{i}"))
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    got = windows.drain(windows.windowed(stream, "ts", "1 hour", watermark="2 hours"), "late").collect()
    n = {int(r["w"]["start"].timestamp()) // 3600: r["n"] for r in got}
    assert n[1] == 1 and 20 not in n


def ranks_of(edges, seeds, rounds, tol, alpha=0.85):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = [s for s in seeds if s in near]
    restart = {n: (1 / len(seeds) if n in seeds else 0.0) for n in near}
    rank, done = dict(restart), 0
    for _ in range(rounds):
        step = {n: (1 - alpha) * restart[n] + alpha * sum(rank[m] / len(near[m]) for m in near[n]) for n in near}
        moved, rank, done = sum(abs(step[n] - rank[n]) for n in near), step, done + 1
        if moved <= tol:
            break
    return rank, done


def test_pagerank_runs_until_it_settles(spark):
    path = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n2", "n7"), ("n0", "x"), ("x", "n1")]
    star = [("hub", f"leaf{i}") for i in range(4)] + [("leaf0", "leaf1")]
    for edges, seeds, args in [(path, ["n0", "n3", "absent"], {}), (path[:9], ["n0"], {"alpha": 0.5}), (star, ["hub"], {"tol": 0.01}), (path, ["n0"], {"iterations": 4, "tol": 0.0})]:
        want, rounds = ranks_of(edges, seeds, args.get("iterations", 30), args.get("tol", 1e-6), args.get("alpha", 0.85))
        assert (rounds < 30) == bool(args)
        got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "node string"), **args).collect()}
        assert got == pytest.approx(want, abs=1e-12)
        assert min(got.values()) > 0 or args.get("iterations") == 4


def test_pairs_of_pages_are_dealt_once(spark):
    pages = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "page_id int, title string")
    anchors = spark.createDataFrame([(i, "m", a) for i in range(9) for a in (i % 2, i % 4 + 10)], "page_id int, kind string, anchor_id int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = projection.related_pages(pages, anchors, pages.where("page_id = 0").select("page_id"), 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.collect() == [(0, 4, 2, 1), (0, 8, 2, 2), (0, 6, 1, 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    top, _, join = plan.partition("SortMergeJoin ")
    assert join.startswith("[kind")
    assert top.count("Exchange") == 1


def test_intents_are_found_once(spark):
    from orrery.plans import repo

    found = repo.intent_weights(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    texts = spark.createDataFrame([("find the notes of push",), ("commit",), ("",), (None,)], "t string")
    got = [r["i"] for r in texts.select(intents.query_intent(F.col("t")).alias("i")).collect()]
    assert got == [("search", "knowledge", ["find", "notes", "push"], ["push"]), ("commit", "git", ["commit"], []), (None, None, [], []), (None, None, None, None)]


@pytest.mark.parametrize("clash", [False, True])
def test_ranks_flow_over_reached_links_only(spark, monkeypatch, clash):
    """Seeds' component is a tenth of the links; links that repeat count once, a missing end passes nothing on, names may share a hash."""
    if clash:
        monkeypatch.setattr(graph.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rng = random.Random(5)
    edges = [(f"{part}{rng.randrange(6)}", f"{part}{rng.randrange(6)}x") for part in "abcdefghij" for _ in range(12)] * 2 + [("a0", None)]
    near, ends = {}, {x for e in edges for x in e if x}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = {n: 1.0 if n == "a0" else 0.0 for n in ends}
    rank = dict(start)
    for _ in range(12):
        rank = {n: 0.15 * start[n] + 0.85 * sum(rank[m] / len(near[m]) for m in near[n] if m) for n in ends}
    written, keep = [], Saved.keep_sorted

    def spy(self, df, label, keys, buckets):
        out = keep(self, df, label, keys, buckets)
        written.extend([out.count()] if label == "links" else [])
        return out

    monkeypatch.setattr(Saved, "keep_sorted", spy)
    df, seeds = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a0",), ("none",)], "node string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r.node: r.rank for r in graph.pagerank(df, seeds, 12, tol=0.0).collect()}
    assert set(got) == ends | {None} and got.pop(None) == 0.0
    assert all(got[n] == pytest.approx(rank[n], abs=1e-12) for n in ends)
    assert len(written) == 2 and written[1] * 5 < written[0]
    pushed = {r.node: r.rank for r in graph.pushed_ranks(df, seeds.selectExpr("'k' AS kernel", "node"), 12, least=0.0).where("node IS NOT NULL").collect()}
    assert all(pushed.get(n, 0.0) == pytest.approx(rank[n], abs=1e-12) for n in ends)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
