"""Request parsers, sources, snapshots."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import hits, requests
from orrery.sources import tables


def test_directives():
    r = requests.directives('limit:5 tag:(a|b) to:"x y" sort:-score,path case:yes match:exact free "quoted words" limit:0 foo:bar')
    assert (r.limit, r.match, r.case_sensitive) == (5, "exact", True)
    assert r.lists == {"tags": ["a", "b"], "link_to": ["x y"]}
    assert r.sort == [("score", True), ("path", False)]
    assert r.text == "free quoted words foo:bar"
    assert requests.directives("").text == ""


def test_table_query():
    name, cols, args = requests.table_query('{ x: docs(filter: {a: {gt: -1.5}, b: "q\\"s", c: true}, sort: ["a"], limit: 3) { a, b } }')
    assert (name, cols) == ("docs", ["a", "b"])
    assert args == {"filter": {"a": {"gt": -1.5}, "b": 'q"s', "c": True}, "sort": ["a"], "limit": 3}


@pytest.mark.parametrize("text", ["", "{ a }", "{ a { } }", "{ a { b } c { d } }", "{ a(size: 1) { b } }", "mutation { a { b } }", "{ a { b }", "{ a(limit: ) { b } }", "{ a { b } } %"])
def test_table_query_refuses(text):
    with pytest.raises(ValueError):
        requests.table_query(text)


def test_table_query_rows(spark):
    t = {"t": spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "i int, s string")}
    assert [r["i"] for r in requests.run_table_query(t, '{ t(sort: [{column: "s", order: desc}]) { i } }').collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        requests.run_table_query(t, "{ t(page: 2) { i } }")
    with pytest.raises(ValueError):
        requests.run_table_query(t, "{ u { i } }")


def test_markdown_files_and_inventory(spark, tmp_path):
    for name, text in {"plan/a.md": "# P", "blueprint/x/b.md": "# B", "plan/c.txt": "no", "other/d.md": "no"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = sorted(map(tuple, tables.markdown_files(spark, str(tmp_path)).collect()))
    assert got == [("blueprint", "blueprint/x/b.md", "# B"), ("plan", "plan/a.md", "# P")]
    assert tables.inventory(spark, str(tmp_path), "*.md").count() == 3


def test_graph_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a",), ("b",)], "name string")
    r = spark.createDataFrame([("a", "b"), ("a", "zz")], "src string, dst string")
    tables.save_graph(e, r, str(tmp_path / "g"))
    e2, r2 = tables.load_graph(spark, str(tmp_path / "g"))
    assert e2.count() == 2 and [tuple(x) for x in r2.collect()] == [("a", "b")]


def test_snapshots_go_back(spark):
    log = spark.createDataFrame([("k", 1, "one"), ("k", 2, None), ("j", 1, "j")], "id string, n int, payload string")
    assert {r["id"]: r["payload"] for r in tables.snapshot_at(log, "id", "n", 1).collect()} == {"k": "one", "j": "j"}
    assert {r["id"]: r["payload"] for r in tables.snapshot_at(log, "id", "n", 2).collect()} == {"j": "j"}


def test_sparse_keywords_leave_the_lead_to_vectors(spark):
    row = "name string, score double, rank int, routing_keywords array<string>, intents array<string>, category string, description string"
    v = spark.createDataFrame([("git.commit", 0.9, 0), ("x", 0.5, 1)], "name string, score double, rank int")
    k = spark.createDataFrame([("x", 3.0, 0, ["save"], None, "vcs", None)], row)
    got = {r["name"]: r["rrf"] for r in hits.weighted_rrf(v, k, "save now").collect()}
    assert got["git.commit"] == pytest.approx(2 / 11 + 0.27)
    assert got["x"] == pytest.approx(2 / 12 + 0.15 + 0.1 / 11 + 0.08)


def test_empty_hits(spark):
    none = spark.createDataFrame([], "path string, score double")
    r = hits.graph_confidence(none, 3, 0.5).collect()[0]
    assert (r["confidence"], r["level"], r["sufficient"]) == (0.0, "none", False)
    assert hits.definitions(spark.createDataFrame([], "name string, path string, language string"), "x").count() == 0
    assert not spark.range(1).select(hits.under_path(F.lit("a/b"), "").alias("x")).collect()[0]["x"]
