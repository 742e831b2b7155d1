"""Searches side by side: what ends in time counts, what does not is cancelled and told."""

import time

from pyspark.sql import functions as F

from orrery.operators import fanout, projection


def hits(spark, n):
    return spark.createDataFrame([(f"{n}-{i}", f"p{i}", 1.0 / (i + 1)) for i in range(3)], "id string, path string, score double")


def slow(spark):
    @F.udf("double")
    def wait(x):
        time.sleep(60)
        return x

    return hits(spark, "slow").withColumn("score", wait("score"))


def test_the_budget_cuts_what_is_still_running(spark):
    sources = {"a": lambda q, n: hits(spark, "a"), "b": lambda q, n: slow(spark), "c": lambda q, n: hits(spark, "c").where(F.raise_error(F.lit("broken")).isNull()), "d": lambda q, n: hits(spark, "d")}
    began = time.monotonic()
    got = fanout.code_search(spark, "x", sources, 10, seconds=25.0)
    rows = got.collect()
    assert time.monotonic() - began < 50
    assert {r.source for r in rows} == {"a", "d"} and len(rows) == 6
    assert rows[0].pending == ["b"] and rows[0].skipped == ["c"] and rows[0].partial
    later = fanout.code_search(spark, "x", {n: sources[n] for n in ("b", "a")}, 10, seconds=6.0, side_by_side=1).collect()
    assert later == [] or {r.source for r in later} <= {"a"}
    assert fanout.code_search(spark, "x", {}, 10).collect() == []


def test_a_query_that_names_a_repository_searches_it_alone(spark):
    assert fanout.repo_hint(" My_Repo.jl ", ["my-repo", "other"]) == "my-repo"
    assert fanout.repo_hint("my repo", ["my-repo", "My.Repo"]) is None and fanout.repo_hint("", ["a"]) is None
    rows = fanout.code_search(spark, "Alpha", {"alpha": lambda q, n: hits(spark, n), "beta": lambda q, n: slow(spark)}, 2).collect()
    assert [r.id for r in rows] == ["2-0", "2-1"] and rows[0].skipped == ["beta"] and not rows[0].pending


def test_a_gap_whose_page_is_missing_stays_in_the_workset(spark):
    pages = spark.createDataFrame([(1, "how_to", "a"), (2, "how_to", "b"), (3, "tutorial", "c")], "page_id int, kind string, title string")
    anchors = spark.createDataFrame([(1, "m", "x"), (2, "m", "x"), (3, "m", "x"), (3, "s", "y"), (1, "s", "y")], "page_id int, kind string, anchor_id string")
    gaps = spark.createDataFrame([("k", 1, 1), ("k", 9, 9)], "kind string, entity_id int, page_id int")
    got = sorted((r.entity_id, r.found, r.role, r.other_id, r.score, r.position) for r in projection.planner_items(gaps, pages, anchors, 1, "how_to", 5).collect() if r.found)
    assert got == [(1, True, "family", 2, 1, 1), (1, True, "page", 1, None, 0), (1, True, "related", 3, 2, 1)]
    assert [r.found for r in projection.planner_items(gaps, pages, anchors, 1, None, 5).where("entity_id = 9").collect()] == [False]
    empty = projection.planner_workset(spark.createDataFrame([], "kind string, page_kind string, entity_id int, points int"), 5)
    assert empty.count() == 0
