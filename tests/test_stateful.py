"""Streams with state: replays equal plain folds, restarts go on from the checkpoint, silence and repeats count once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import state
from orrery.streaming import changes, stateful

SCHEMA = "k string, o bigint, ts timestamp"


def rows(spark, given):
    return spark.createDataFrame([(k, o, s) for k, o, s in given], "k string, o bigint, s double").select("k", "o", F.timestamp_seconds("s").alias("ts"))


def plain(given):
    score, last, n = {}, {}, {}
    for k, _, s in sorted(given, key=lambda r: r[1]):
        x = score.get(k, 5.0) * math.exp(-0.05 * max(0.0, s - last.get(k, s)) / 86400)
        score[k], last[k], n[k] = min(max(x + 0.5 * math.log(2), 1), 10), s, n.get(k, 0) + 1
    return {k: (score[k], n[k]) for k in score}


def test_touches_go_on_from_the_checkpoint(spark):
    first = [("a", 2, 1e6), ("a", 1, 0.0), ("b", 3, 5e6), (None, 4, 1.0)]
    second = [("a", 5, 9e6), ("c", 6, 9e6), ("b", 7, 1e6)]  # b's clock goes back
    run = stateful.Replay(spark, "t", rows(spark, first).schema, lambda s: stateful.touched(s, "k", "o", "ts"))
    run.feed(rows(spark, first))
    run.feed(rows(spark, second).limit(0))
    run.feed(rows(spark, second))
    got = {r.k: (r.saliency, r.n) for r in run.rows().groupBy("k").agg(F.max_by("saliency", "n").alias("saliency"), F.max("n").alias("n")).collect()}
    want = plain(first + second)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert run.rows().where("k = 'a'").count() == 2  # a row for each micro-batch with touches


def test_silence_is_told_by_a_timer(spark):
    run = stateful.Replay(spark, "s", rows(spark, []).schema, lambda s: stateful.touched(s, "k", "o", "ts", silent=3 * 86400.0))
    for given in ([("a", 1, 86400.0), ("b", 2, 86400.0)], [("b", 3, 3 * 86400.0)], [("z", 4, 5 * 86400.0)], [("z", 5, 6 * 86400.0)]):
        run.feed(rows(spark, given))
    told = run.rows().where("event = 'silence'").collect()
    assert [r.k for r in told] == ["a"]
    assert told[0].last == 4 * 86400.0 and told[0].saliency == pytest.approx(max(1, (5 + 0.5 * math.log(2)) * math.exp(-0.15)))


def test_rings_hold_the_last_rows(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i, None if i % 5 == 0 else f"t{i}") for i in range(20)], "k string, o bigint, text string")
    run = stateful.Replay(spark, "r", df.schema, lambda s: stateful.rings(s, "k", "o", 3))
    for part in stateful.sliced(df, "o", 3):
        run.feed(part)
    last = {}
    for r in run.rows().collect():
        if r.seen >= last.get(r.k, (0, {}))[0]:
            last.setdefault(r.k, (0, {}))
            last[r.k] = (r.seen, {**(last[r.k][1] if last[r.k][0] == r.seen else {}), r.slot: (r.o, r.text)})
    for k in ("s0", "s1", "s2"):
        own = [(i, None if i % 5 == 0 else f"t{i}") for i in range(20) if f"s{i % 3}" == k]
        assert last[k] == (len(own), dict(enumerate(own[-3:])))
    assert stateful.sliced(df.limit(0), "o", 3)[0].count() == 0


def test_a_followed_table_takes_each_batch_once(spark, tmp_path, monkeypatch):
    schema = "id bigint, seq bigint, op string, v string"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    state = lambda f: {r.id: (r.seq, r.v) for r in f.read().collect()}
    f = changes.Follower(spark, str(tmp_path), "id", ["seq"], F.col("op") == "D")
    f.feed(make((1, 1, "I", "a"), (2, 1, "I", "b"), (1, 2, "U", "c"), (None, 9, "I", "x")))
    assert state(f) == {1: (2, "c"), 2: (1, "b")}
    f.feed(make((2, 5, "D", None), (1, 1, "U", "late"), (3, None, "I", "n")))
    assert state(f) == {1: (2, "c"), 3: (None, "n")}
    f.feed(make((2, 4, "U", "late"), (2, 5, "U", "tie")))  # a removed key does not come back
    assert state(f) == {1: (2, "c"), 3: (None, "n")}
    before = f.table.versions()
    f.apply(make((1, 7, "U", "again")), 1)  # a batch number that has been applied
    assert f.table.versions() == before
    real, failed = f.table._commit, []

    def failing(*a, **k):
        if not failed:
            failed.append(1)
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(f.table, "_commit", failing)
    with pytest.raises(Exception):
        f.feed(make((1, 8, "U", "d")))
    assert state(f)[1] == (2, "c")
    f.feed(make((3, 9, "U", "e")))  # the failed batch is repeated, then the new one
    assert state(f) == {1: (8, "d"), 3: (9, "e")}
    assert {r.id for r in f.read(f.table.versions()[0]).collect()} == {1, 2}
    f.table.compact()
    assert state(f) == {1: (8, "d"), 3: (9, "e")} and f.table.manifest()["dead"] == []


def test_transitions_of_a_hot_key_are_composed(spark):
    rng = random.Random(3)
    rules = {("none", "a"): "x", ("x", "b"): "y", ("y", "a"): "x", ("y", "c"): "none", ("x", "x"): "x"}
    rows = [("hot", i, rng.choice("abcx")) for i in range(700)] + [(f"k{i % 9}", i, rng.choice(["a", "b", None, "?"])) for i in range(60)] + [(None, 1, "a"), (None, 2, "b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "k string, o int, act string, before_ string")
    want, now = {}, {}
    for k, o, act in sorted(rows, key=lambda r: r[1]):
        s = now.get(k, "none")
        now[k] = rules.get((s, act), s)
        want[k, o] = (s, now[k], (s, act) in rules)
    for size, step in ((100, 16), (10_000, 256)):
        got = {(r.k, r.o): (r.before, r.after, bool(r.legal)) for r in state.transitions(df, "k", "o", "act", rules, "none", rows=size, step=step).collect()}
        assert got == want
    assert state.transitions(df.limit(0), "k", "o", "act", rules, "none").count() == 0


def test_streams_hand_the_state_a_list_for_each_key(spark):
    big = 2**53 + 1  # a data frame would make it a double beside a null
    given = [(i % 3 if i % 3 else None, i, big + i if i % 4 else None, [i, None]) for i in range(40)]
    df = spark.createDataFrame(given, "k int, o bigint, v bigint, l array<int>").selectExpr("*", "timestamp_seconds(o) AS t", "CAST(timestamp_seconds(o) AS timestamp_ntz) AS z")
    rows = stateful.listed(df.coalesce(1), "k", "o", 3).collect()
    assert {r.k: (r._seen, r.o) for r in rows} == {k: (len(own), own[-3:]) for k in (None, 1, 2) if (own := [o for g, o, *_ in given if g == k])}
    run = stateful.Replay(spark, "l", df.schema, lambda s: stateful.rings(s, "k", "o", 3, ttl_ms=10**9))
    for part in stateful.sliced(df, "o", 2):
        run.feed(part)
    last = run.rows().where("seen = CASE WHEN k IS NULL THEN 14 ELSE 13 END")
    want = df.where("o >= 31").selectExpr("*", "(o - 31) div 3 AS slot")
    assert sorted(map(repr, last.drop("seen", "run").collect())) == sorted(map(repr, want.collect())) and last.count() == 9
