"""Table functions of SQL, and filters split between scan and rows."""

import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from orrery.operators import search, surface
from orrery.sources.relations import Relations, register_batches


def test_relations_by_name(spark):
    r = Relations()
    r.hold("a", "x", pa.table({"k": [1, 2, None], "s": ["p", None, "q"], "d": pa.array([1.5, None, 2.0])}))
    r.hold("a", "y", pa.table({"n": pa.array([], pa.int32())}))
    r.hold("b", "x", pa.table({"l": [["u", "v"], []], "t": [{"i": 1}, {"i": 2}]}))
    r.register(spark, "rel")
    x = spark.sql("SELECT * FROM rel('a', 'x')")
    assert x.dtypes == [("k", "bigint"), ("s", "string"), ("d", "double")]
    assert sorted(map(tuple, x.collect()), key=repr) == [(1, "p", 1.5), (2, None, None), (None, "q", 2.0)]
    assert spark.sql("SELECT * FROM rel('a', 'y')").collect() == [] and spark.sql("SELECT * FROM rel('a', 'y')").dtypes == [("n", "int")]
    assert [(r.l, r.t.i) for r in spark.sql("SELECT * FROM rel('b', 'x') ORDER BY t.i").collect()] == [(["u", "v"], 1), ([], 2)]
    r.hold("a", "x", pa.table({"other": [9]}))  # a query reads what was held at registration
    assert spark.sql("SELECT k FROM rel('a', 'x')").count() == 3
    r.register(spark, "rel")
    assert spark.sql("SELECT other FROM rel('a', 'x')").first()[0] == 9
    with pytest.raises(Exception, match="no relation a.z is held"):
        spark.sql("SELECT * FROM rel('a', 'z')")
    assert r.release("a", "x") and not r.release("a", "x")


def test_relations_are_bounded():
    r = Relations(limit=100)
    r.hold("a", "x", pa.table({"k": list(range(10))}))
    r.hold("a", "x", pa.table({"k": list(range(12))}))  # in place of the former
    with pytest.raises(ValueError, match="write a table instead"):
        r.hold("a", "y", pa.table({"k": list(range(10))}))


def test_batches_by_key_and_without(spark):
    def sums(rows):
        return rows.group_by("k").aggregate([("v", "sum"), ("v", "count")]).rename_columns(["k", "total", "n"])

    register_batches(spark, "sums", sums, "k string, total bigint, n bigint", gather=50)
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("v"), (F.col("id") % 5).alias("deal"))
    want = sorted(map(tuple, df.groupBy("k").agg(F.sum("v"), F.count("*")).collect()), key=repr)
    merged = "SELECT k, sum(total), sum(n) FROM sums(TABLE(SELECT * FROM {t}){by}) GROUP BY k"
    for by in ("", " PARTITION BY k", " PARTITION BY (k, deal)", " WITH SINGLE PARTITION"):
        assert sorted(map(tuple, spark.sql(merged.replace("{by}", by), t=df).collect()), key=repr) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    parts = spark.sql("SELECT * FROM sums(TABLE(SELECT * FROM {t}) PARTITION BY k)", t=df).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) > len(want) and sum(r.n for r in parts) == 1000  # the hot key comes in several tables
    assert spark.sql("SELECT * FROM sums(TABLE(SELECT * FROM {t}))", t=df.where("v < 0")).collect() == []


def test_batches_keep_types_and_order_of_the_schema(spark):
    register_batches(spark, "halves", lambda t: pa.table({"h": pc.divide(t["v"], 2), "extra": t["v"], "s": pc.cast(t["v"], pa.string())}), "s string, h int")
    got = spark.sql("SELECT * FROM halves(TABLE(SELECT id AS v FROM range(5)))")
    assert got.dtypes == [("s", "string"), ("h", "int")]
    assert sorted(map(tuple, got.collect())) == [("0", 0), ("1", 0), ("2", 1), ("3", 1), ("4", 2)]


def test_plugins_as_table_functions(spark):
    from orrery.plans import states  # noqa: F401  it registers the plugin

    df = spark.createDataFrame([(1, 49.9), (2, 50.0), (3, 99.0)], "event_id bigint, value double")
    surface.register_plugin(spark, "value_bands")
    got = spark.sql("SELECT * FROM value_bands(TABLE(SELECT * FROM {t}))", t=df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, surface.run_plugin(df, "value_bands").collect())) == [(1, "low"), (2, "high"), (3, "high")]


ROWS = [("a", "one", '{"id": "a", "n": 7, "ok": true, "x": {"y": "z"}}'), ("b", "two", '{"n": 7.5, "ok": false}'), ("c", None, "{broken"), ("d", "one", None)]


@pytest.mark.parametrize(
    ("spec", "pushed", "want"),
    [
        (None, False, "abcd"),
        ("  ", False, "abcd"),
        ("id > 'a' AND content = 'one'", True, "d"),
        ('{"id": "a"}', True, "a"),  # on a column, and on the metadata as well
        ('{"id": "b"}', True, ""),
        ({"n": 7}, False, "a"),
        ('{"ok": true}', False, "a"),
        ({"ok": False, "n": 7.5}, False, "b"),
        ({"x.y": "z"}, False, "a"),
        ({"id": "a", "n": 7}, False, "a"),  # one other key: nothing is pushed
        ({"n": {"$gt": 1}}, False, ""),  # metadata knows no operators
        ("[1, 2]", False, "abcd"),
        ({}, False, "abcd"),
    ],
)
def test_filters_are_split(spark, tmp_path, spec, pushed, want):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id string, content string, metadata string").write.parquet(path)
    df = search.filtered(spark.read.parquet(path), spec)
    assert "".join(sorted(r.id for r in df.collect())) == want
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert bool(re.search(r"PushedFilters: \[\w", plan)) == pushed
