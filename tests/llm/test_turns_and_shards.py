"""Sharding and turn reassembly against plain versions, on odd rows and on whole tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import catalog, sharding, turns

SF = "/root/testdata/sf0.001"

# --- op12


def shards_of(spark, docs):
    return [r.asDict() for r in sharding.shard_rows(spark.createDataFrame(docs, "doc_id bigint, text string, shard string, slot int"), sharding.layout(16), sharding.layout(17)).collect()]


def test_odd_rows_are_sharded(spark):
    docs = [(i, "x" * (i % 7), None, 1) for i in range(300)] + [(None, None, "a", 2), (None, "", "b", 3), (5, None, "c", 4), (5, "ß", "d", 5), (5, "ß", "d", 5)] + [(77, "hot", None, 0)] * 150
    got = shards_of(spark, docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in docs)
    by_id, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shards_of(spark, []) == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = catalog.QUERIES["op12_sharding"](spark, SF).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and {r.law for r in rows} == {"key"}
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    for n in (16, 17, 18, 24):
        both = sharding.placed(sharding.placed(ids, sharding.layout(n), "doc_id", "a"), sharding.layout(n + 1), "doc_id", "b")
        assert both.where((F.col("a") != F.col("b")) & (F.col("b") != n)).isEmpty()
        sizes = [r["count"] for r in both.groupBy("b").count().collect()]
        assert len(sizes) == n + 1 and max(sizes) < 1.2 * 40_000 / (n + 1) and min(sizes) > 0.8 * 40_000 / (n + 1)


def test_movement_is_confined_to_the_subtree_whose_weight_changes(spark):
    before = sharding.tree([[[(0, 1), (1, 2)], [(2, 1)]], [[(3, 4)], [(4, 1), (5, 1)]]])
    after = sharding.tree([[[(0, 1), (1, 2)], [(2, 1)]], [[(3, 4)], [(4, 1), (5, 3)]]])  # shard 5 grows
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    both = sharding.placed(sharding.placed(ids, before, "doc_id", "a"), after, "doc_id", "b").groupBy("a", "b").count().collect()
    for r in both:
        if r.a != r.b:  # into the grown region, from elsewhere or within it: never between two that kept their weight
            assert r.b in (3, 4, 5) and not {r.a, r.b} <= {0, 1, 2}
            assert r.a in (0, 1, 2) or r.b in (4, 5)
    total = defaultdict(int)
    for r in both:
        total[r.b] += r["count"]
    for shard, weight in enumerate([1, 2, 1, 4, 1, 3]):
        assert abs(total[shard] / 30_000 - weight / 12) < 4 * math.sqrt(weight / 12 / 30_000)


def test_a_level_draws_like_a_plain_version(spark):
    root = sharding.layout(17)
    got = sharding.placed(spark.range(200).withColumnRenamed("id", "doc_id"), root, "doc_id", "s")
    names = [x.name for r in root.children for x in [r, *r.children, *[s for k in r.children for s in k.children]]]
    hashed = got.select("doc_id", "s", *[F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(n)), F.lit(1 << 53)).alias(n) for n in names])
    for r in hashed.collect():
        node = root
        while node.children:
            node = min(node.children, key=lambda c: -math.log((r[c.name] + 1) / 2**53) / c.weight)
        assert node.shard == r["s"]


# --- op13


def plain_turns(rows, batches=12):
    turns_of, first = defaultdict(lambda: defaultdict(dict)), {}
    for conv, turn, role, text in rows:
        if turn is None:
            continue
        role, text = role or "", text or ""
        first[conv] = min(first.get(conv, turn), turn)
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        for b, r in [(h % batches, role)] + [((h + 3) % batches, "user")] * (h % 7 < 2):
            new = (f"{r}|{text}".encode(), r)
            turns_of[b][conv][turn] = min(turns_of[b][conv].get(turn, new), new)
    kept, released, last, closed, out = defaultdict(dict), {}, {}, set(), []

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    def close(conv, batch):
        closed.add(conv)
        own = kept[conv]
        left = [t for t in sorted(own) if t >= released[conv]]
        missing = max(own) - first[conv] + 1 - len(own)
        breaks = sum(t - 1 in own and own[t][1] == own[t - 1][1] for t in own)
        out.append(("close", conv, -1, batch, sha(",".join(map(str, left)).encode()), missing, breaks))

    for batch in range(batches):
        for conv, arrived in turns_of[batch].items():
            if conv in closed:
                out.extend(("reject", conv, t, batch, sha(p), None, None) for t, (p, _) in arrived.items())
                continue
            last[conv] = batch
            released.setdefault(conv, first[conv])
            for t, p in arrived.items():
                kept[conv].setdefault(t, p)
            while released[conv] in kept[conv]:
                out.append(("release", conv, released[conv], batch, sha(kept[conv][released[conv]][0]), None, None))
                released[conv] += 1
        for conv in [c for c in last if c not in closed and batch - last[c] >= 3]:
            close(conv, batch)
    for conv in [c for c in last if c not in closed]:
        close(conv, batches)
    return sorted(out, key=repr)


def events(df):
    return sorted(((r.event, r.conv_id, r.turn, r.batch, r.sha256, r.n_missing, r.n_breaks) for r in df.collect()), key=repr)


@pytest.fixture
def op13_on(spark, tmp_path):
    def run(rows, schema="conv_id bigint, turn bigint, role string, text string, batch string, first int"):
        spark.createDataFrame([(*r, None, 9) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
        return events(catalog.QUERIES["op13_turn_reassembly"](spark, str(tmp_path)))

    return run


def test_turns_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_turns(rows)
    assert {w[0] for w in want} == {"release", "close", "reject"}
    assert events(catalog.QUERIES["op13_turn_reassembly"](spark, SF)) == want


def test_odd_turns(op13_on):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(200)]  # one conversation holds most rows
    rows += [(2, -3, None, None), (2, None, "user", "x"), (2, 2**40, "a|b", "c"), (2, 2**40, "a", "b|c"), (3, None, None, None), (None, 1, "user", ""), (None, 0, "", "é\n")]
    rows += [(4, 7, "user", "b"), (4, 7, "user", "a"), (4, 7, "user", "a"), (4, 8, "user", "x" * 50_000), (4, 9, "ü", "z"), (4, 11, "s", "")]
    assert op13_on(rows) == plain_turns(rows)


def test_no_turns(op13_on):
    assert op13_on([]) == []
