"""Operators that SQL cannot check: digests, token pieces, versions, Arrow streams, builds, kernels in one task and by joins."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import intents
from orrery.functions import scalars as sc
from orrery.operators import graph, linkgraph, repo, state, stats, surface, tools
from orrery.sources import versions
from orrery.sources.shared import Saved, clean_up, cut, new_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_digest_sorts_keys(spark):
    assert intents.fnv1a(b"a") == 0xAF63DC4C8601EC8C and intents.fnv1a(b"") == 0xCBF29CE484222325
    df = spark.createDataFrame([('{"b": 1, "a": [2]}',), ('{"a":[2],"b":1}',), ("{}",), (None,), ("no",)], "j string")
    got = [r[0] for r in df.select(intents.json_digest("j")).collect()]
    assert got[0] == got[1] == f"fnv1a64:{intents.fnv1a(b'{\"a\":[2],\"b\":1}'):016x}" and got[2:] == ["fnv1a64:empty"] * 3


def test_token_pieces_go_back_to_the_text(spark):
    texts = ["The house of the stone bridge, 12345 times.\n\nAgain!", "", None, "Größe 北京 naïve"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", intents.token_count(F.col("t"), RANKS).alias("n"), intents.truncated(F.col("t"), RANKS, 4).alias("head"), intents.token_chunks(F.col("t"), RANKS, 5, 2).alias("chunks"), intents.token_chunks(F.col("t"), RANKS, 1000).alias("whole")).collect()
    for r in rows:
        assert (r.n > 0) == bool(r.t) and (r.t or "").startswith(r.head) and r.whole == ([r.t] if r.t else [])
        assert len(r.chunks) == (0 if not r.n else max(1, -(-(r.n - 2) // 3)))
    with pytest.raises(ValueError):
        intents.token_chunks(F.col("t"), RANKS, 5, 5)


def test_intent_vectors_are_units(spark):
    v = [r[0] for r in spark.createDataFrame([("a",), ("b",), ("a",)], "t string").select(intents.intent_vector(F.col("t"), 32)).collect()]
    assert v[0] == v[2] != v[1] and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v)


def test_intents(spark):
    texts = ["Find the notes about git", "commit", "crawl some-page/now", "", "please help"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(intents.query_intent(F.col("t"))).collect()]
    assert [(r.action, r.target) for r in got] == [("search", "knowledge"), ("commit", "git"), ("crawl", "web"), (None, None), (None, None)]
    assert got[0].keywords == ["find", "notes", "git"] and got[0].context == ["git"] and got[2].context == ["now"]


def test_osa_distance_against_a_plain_version(spark):
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 8, 80)]
    pairs = [*zip(words[::2], words[1::2], strict=True), ("ab", "ba")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sc.osa_distance("a", "b").alias("d")).collect()
    assert all(r.d == plain(r.a, r.b) for r in got)


def test_versions(spark):
    t = versions.VersionedTable(spark, new_path(spark, "test"))
    assert t.versions() == []
    with pytest.raises(ValueError):
        t.read()
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
    t.append(spark.createDataFrame([(3,)], "id int"))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "b"), (3, None)] and t.read(1).count() == 2
    assert t.info() == {"version": 2, "rows": 3, "columns": ["id", "name"], "parts": 2}
    assert [(r.part, r.rows) for r in t.fragments().collect()] == [(0, 2), (1, 1)]
    assert t.pending_migrations({"id": "bigint", "name": "string"}) == {"id": "bigint"}
    assert t.migrate({"id": "bigint", "tag": "string"}) == 3 and t.read().dtypes == [("id", "bigint"), ("name", "string"), ("tag", "string")] and t.migrate({"id": "bigint"}) is None
    assert t.delete(F.col("name") == "a") == 4 and t.read().count() == 2 and t.checkout(1) == 5 and t.read().count() == 2
    t.drop()
    assert t.versions() == []


def test_arrow_streams_keep_rows_and_metadata(spark):
    data = versions.to_ipc(spark.range(5), 3, {"who": "me"}, "t-1")
    df, meta = versions.from_ipc(spark, data)
    assert [r.id for r in df.collect()] == [0, 1, 2] and meta["who"] == "me" and meta["trace_id"] == "t-1"


def plain_ranks(near, seeds, rounds, alpha=0.85):
    seeds = [x for x in seeds if x in near]
    restart = {n: 1 / len(seeds) if n in seeds else 0.0 for n in near}
    rank = dict(restart)
    for _ in range(rounds):
        rank = {n: (1 - alpha) * restart[n] + alpha * sum(rank[m] / len(near[m]) for m in near[n]) for n in near}
    return rank


def plain_distances(pairs, seeds, hops):
    found = dict.fromkeys(seeds, 0)
    for hop in range(1, hops + 1):
        found |= {b: hop for a, b in pairs if a in found and found[a] == hop - 1 and b not in found}
    return found


def test_graph_joins_against_plain_versions(spark):
    rng = np.random.default_rng(2)
    pairs = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (150, 2))} | {("hub", f"n{i}") for i in range(60)}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    edges = spark.createDataFrame(sorted(pairs) * 2, "src string, dst string")
    names = ["n1", "n2", "missing"]
    seeds = spark.createDataFrame([(n,) for n in names], "node string")
    back = {(b, a) for a, b in pairs}
    for way, own in (("out", pairs), ("in", back), ("both", pairs | back)):
        for hops in (0, 1, 3):
            assert dict(graph.distances(edges, seeds, hops, way).collect()) == plain_distances(own, names, hops)
    assert dict(graph.pagerank(edges, seeds, 30, tol=0.0).collect()) == pytest.approx(plain_ranks(near, names, 30), abs=1e-12)
    got = graph.related(edges, seeds, 2, 10).collect()
    horizon = {n for n, d in plain_distances(pairs | back, names, 2).items() if n in near}
    inner = plain_ranks({n: near[n] & horizon for n in horizon}, names, 30)
    assert [r.node for r in got] == sorted((n for n in horizon if n not in names), key=lambda n: (-round(inner[n], 9), n))[:10] or [r.score for r in got] == pytest.approx(sorted((v for n, v in inner.items() if n not in names), reverse=True)[:10], abs=1e-6)
    none = edges.limit(0)
    assert graph.pagerank(none, seeds).count() == 0 == graph.pushed_ranks(none, seeds.withColumn("kernel", F.lit(1))).count()


def test_pushed_ranks_equal_power_rounds_within_their_bound(spark):
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 80, (160, 2)) if a != b}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    kernels = {"x": [1, 2], "y": [40], "z": [999]}
    seeds = spark.createDataFrame([(k, n) for k, v in kernels.items() for n in v if n in near or k == "z"], "kernel string, node int")
    for least, waves in ((0.0, 30), (1e-9, 30), (1e-3, 30), (0.0, 4)):
        rows = graph.pushed_ranks(edges, seeds, waves, least=least).collect()
        assert {r.kernel for r in rows} == {"x", "y"}
        for k in ("x", "y"):
            want = plain_ranks(near, kernels[k], waves)
            got = {r.node: r["rank"] for r in rows if r.kernel == k}
            bound = max(r.missing for r in rows if r.kernel == k)
            assert all(-1e-12 <= want[n] - got.get(n, 0.0) <= bound + 1e-12 for n in want)
            assert bound < (1e-12 if not least else 1e-5 if least < 1e-6 else 0.7)
            assert least or got == pytest.approx({n: v for n, v in want.items() if v}, abs=1e-12)
    best = {r.node: r["rank"] for r in graph.fused(graph.pushed_ranks(edges, seeds, 30)).collect()}
    assert best == pytest.approx({n: max(plain_ranks(near, v, 30)[n] for v in (kernels["x"], kernels["y"])) for n in best}, abs=1e-6)
    assert "SinglePartition" not in graph.pushed_ranks(edges, seeds, 3)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_dense_clusters_refuse_what_no_task_may_hold(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_EDGES", 1)
    nodes = spark.createDataFrame([(x, 0.9, 5) for x in "abc"], "node string, score double, activations int")
    with pytest.raises(ValueError):
        graph.dense_clusters(nodes, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"), 0.5)


def test_pages_fall_back_to_near_titles(spark):
    pages = spark.createDataFrame([(1, "reference", "Engine", "a/x", ["k"]), (2, "how_to", "Engines", "b", None), (3, "how_to", "Other", "c", ["none"])], "page_id int, kind string, title string, path string, keywords array<string>")
    points = lambda *a: [(r.page_id, r.points) for r in repo.search_pages(pages, *a).collect()]
    assert points("engine", 5) == [(1, 100), (2, 85)] and points("engine", 5, "how_to") == [(2, 85)]
    assert points("enigne", 5) == [(1, 45 + int(35 * (1 - 2 / 6)))] and points("zzz", 5) == [] and points(" ", 5) == []


def test_tools(spark):
    assert tools.asks_for_files("find *.py") and tools.asks_for_files("where is x.rs") and not tools.asks_for_files("sum it up")
    rows = spark.createDataFrame([("a", "c", "lists a directory", ["x"], ["y"]), ("b", "c", "adds", [], [])], "name string, category string, description string, routing_keywords array<string>, intents array<string>")
    assert [r[0] for r in rows.select(tools.finds_files()).collect()] == [True, False]
    assert tools.over_fetch(10, False) == 20 and tools.over_fetch(10, True) == 60 and stats.candidate_window(50) == 96 and stats.retained_window(10, 3, 64) == (64, 128)
    v = spark.createDataFrame([("small bolt", 0.9, "x"), ("gear", 0.5, "y"), ("nut", 0.1, "y")], "name string, score double, category string")
    k = rows.withColumn("score", F.lit(0.8)).withColumn("name", F.lit("small bolt")).limit(1)
    both = tools.agentic_search(v, k, "bolt").collect()
    assert both[0].name == "small bolt" and both[0].score > 0.3
    assert [r.name for r in tools.agentic_search(v, k, "bolt", "semantic", category="y").collect()] == ["gear"]
    assert tools.cut_list(v, "score", "name", 1, 0.2).count() == 1


def test_builds_need_their_lease():
    b = state.Builds()
    one = b.begin("docs", "f1")
    assert b.begin("docs", "f1") is None and b.report("docs", one, 0.5) and b.progress["docs"] == 0.5
    two = b.begin("docs", "f2")
    assert not b.finish("docs", one) and b.finish("docs", two) and b.begin("docs", "f2") is None and b.begin("docs", "f3") == 3


def test_planned_search_strategies(spark):
    rows = [(1, "alpha", "Alpha Guide", "docs/alpha", ["x"], "about alpha things"), (2, "beta", "Beta", "docs/beta", ["y"], "alpha is named"), (3, "gamma", "Gamma", "other/gamma", ["x"], "nothing")]
    notes = spark.createDataFrame(rows, "doc_id bigint, stem string, title string, path string, tags array<string>, text string")
    note = linkgraph.Note(F.col("stem"), F.col("stem"), F.col("title"), F.col("path"), F.col("tags"), F.col("text")).folded()
    found = lambda text, **a: [r.doc_id for r in linkgraph.planned_search(notes, note, text, 10, **a).collect()]
    assert found("alpha") == [1, 2] and found("alpha limit:1") == [1] and found("alpha tag:y") == [2] and found("tag:x") == [1, 3]
    assert found("alpha match:exact")[0] == 1 and found("^be match:re") == [2] and found("docs match:fuzzy") == [1, 2]
    boosts = spark.createDataFrame([(3, 0.9), (2, 1.0)], "doc_id bigint, boost double")
    assert found("alpha", boosts=boosts)[0] in (1, 2) and 3 in found("alpha", boosts=boosts)
    edges = spark.createDataFrame([(1, 2), (3, 1)], "src bigint, dst bigint")
    assert found("alpha from:alpha", edges=edges) == [2] and found("alpha to:alpha", edges=edges) == [] and found("to:alpha", edges=edges) == [3]
    with pytest.raises(ValueError):
        found("alpha", strategy="none")


def test_observed_search_counts_rows(spark):
    out, seen, matched = stats.observed_search(spark.range(1000), F.col("id") % 10 == 0, [F.desc("id")], 5)
    assert [r.id for r in out.collect()] == [990, 980, 970, 960, 950]
    assert seen.get["rows"] == 1000 and matched.get["rows"] == 100


def test_payload_and_plan(spark):
    got = surface.sql_payload(spark, "SELECT id, NULL AS x FROM {t} ORDER BY id", 2, t=spark.range(3))
    assert got["rows"] == [{"id": 0, "x": None}, {"id": 1, "x": None}] and got["more"] and got["columns"][0] == {"name": "id", "type": "bigint"}
    assert surface.plan_summary(spark.range(3).groupBy("id").count()).get("HashAggregate", 0) >= 1


def test_clean_up_deletes_what_was_written(spark):
    df = cut(spark.range(3), "gone")
    kept = Saved(spark, "gone").keep_sorted(spark.range(3), "x", ["id"], 2)
    assert df.count() == 3 and kept.count() == 3 and clean_up(spark) >= 2
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(kept._saved_path).count()


def test_as_of_and_folds_over_sparse_numbers_and_hot_keys(spark, monkeypatch):
    from orrery.operators import joins

    rng = np.random.default_rng(3)
    monkeypatch.setattr(joins, "RANGE_ROWS", 20)
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 150), rng.integers(0, 10**9, 150), strict=True))]
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 10**9, 60), strict=True))]
    got = joins.as_of(spark.createDataFrame(left, "k int, t bigint, i int"), spark.createDataFrame(right, "k int, u bigint, v int"), "k", "t", "u", "v").collect()
    want = {i: max(((u, v) for q, u, v in right if q == k and u <= t), default=(0, None))[1] for k, t, i in left}
    assert {r.i: r.v for r in got} == want and len(got) == 150
    rows = [(0, int(t), float(v)) for t, v in zip(np.sort(rng.integers(0, 10**15, 200)), rng.normal(0, 1, 200), strict=True)]
    x = 1.0
    for _, _, v in rows:
        x = min(max(0.9 * x + v, 0.0), 2.0)
    r = state.ordered_fold(spark.createDataFrame(rows, "k int, o bigint, v double"), "k", "o", F.lit(0.9), F.col("v"), 0.0, 2.0, 1.0, rows=16).first()
    assert r.n == 200 and abs(r.state - x) < 1e-9
    assert joins.in_ranges(spark.createDataFrame(rows, "k int, o bigint, v double"), ["k", "o"], 16).groupBy("_range").count().agg(F.max("count")).first()[0] < 60
    points = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "k int, at int")
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 40, "b"), (2, 6, 4, "c"), (2, 5, 5, "d")], "k int, lo int, hi int, name string")
    found = joins.within(points, spans, "k", F.col("at"), F.col("lo"), F.col("hi"), 4)
    assert sorted((r.k, r["at"], r.name) for r in found.collect()) == [(1, 5, "a"), (1, 5, "b"), (1, 9, "b"), (2, 5, "d")]
