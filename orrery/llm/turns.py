"""Conversation turn reassembly: turns that arrive in batches, out of order and repeated, released in order by a stream.

A conversation's state is a min-heap of its kept, unreleased turns and the kept-turn set, which is the released run
[first, next) and the heap.  A batch pushes what is new and pops while the top is the next turn.  Every batch is a new
start of the query on one checkpoint; its number comes with the closure, and by it a timeout, which visits every open
conversation without arrivals, knows how long the conversation has been silent.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.llm.common import Saved, table
from orrery.sources.shared import new_path

BATCHES = 12
#: Batches in a row without arrivals that close a conversation.
SILENT = 3
EVENTS = "event string, conv_id {kind}, turn bigint, batch bigint, payload string, unreleased array<bigint>, n_missing bigint, n_breaks bigint"
COLUMNS = ["event", "conv_id", "turn", "batch", "payload", "unreleased", "n_missing", "n_breaks"]


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(conv_id, turn, batch, role, payload, first): which turns arrive in which batch.

    A turn's batch is a hash of ``conv_id:turn``; two of seven arrive once more with role ``user``, three batches on.
    Null turns are dropped; a null role or text is empty, a null conv_id is a conversation of its own.  Of equal turns
    of a batch the smallest ``role|text`` arrives (of equal ones with the smallest role).  ``first`` is the
    conversation's smallest turn.
    """
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where("turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    turns = turns.withColumn("h", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"))

    def arrival(batch: Column, role: Column) -> Column:
        return F.struct((batch % batches).alias("batch"), role.alias("role"))

    once, again = arrival(F.col("h"), F.col("role")), arrival(F.col("h") + 3, F.lit("user"))
    each = turns.select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))).alias("a"))
    payload = F.concat(F.col("a.role"), F.lit("|"), F.col("text"))
    least = each.groupBy("conv_id", "turn", F.col("a.batch").alias("batch")).agg(F.min(F.struct(payload.alias("payload"), F.col("a.role").alias("role"))).alias("p"))
    first = turns.groupBy(F.col("conv_id").alias("of")).agg(F.min("turn").alias("first"))
    out = least.join(first, F.col("conv_id").eqNullSafe(F.col("of")))
    return out.select("conv_id", "turn", "batch", "p.role", "p.payload", "first")


class Kept:
    """The state of one conversation."""

    def __init__(self, first: int, batch: int) -> None:
        self.first = self.next = first
        self.heap: list[list] = []  # [turn, role, payload]
        self.role: str | None = None  # of turn next - 1
        self.breaks, self.last, self.closed = 0, batch, False

    @staticmethod
    def of(data: str) -> Kept:
        kept = Kept(0, 0)
        kept.__dict__.update(json.loads(data))
        return kept

    def dump(self) -> str:
        return json.dumps({"closed": True} if self.closed else self.__dict__)

    def arrive(self, batch: int, rows: Iterator[tuple[int, str, str]]) -> Iterator[tuple[int, str]]:
        """Keep the turns that are new; (turn, payload) of those that this lets go."""
        known = {t[0] for t in self.heap}
        self.last = batch
        for turn, role, payload in rows:
            if turn >= self.next and turn not in known:
                heapq.heappush(self.heap, [turn, role, payload])
        while self.heap and self.heap[0][0] == self.next:
            turn, role, payload = heapq.heappop(self.heap)
            self.breaks += role == self.role
            self.role, self.next = role, turn + 1
            yield turn, payload

    def close(self) -> tuple[list[int], int, int]:
        """Unreleased turns, ascending; how many turns are missing below the largest kept one; role breaks."""
        left = sorted(self.heap)
        turns = [t[0] for t in left]
        breaks = self.breaks + sum(b[0] == a[0] + 1 and b[1] == a[1] for a, b in zip(left, left[1:], strict=False))
        largest = turns[-1] if turns else self.next - 1
        self.closed = True
        return turns, largest + 1 - self.next - len(turns), breaks


def step(batch: int, end: bool, silent: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What one start of the query does to a conversation; ``batch`` is the start's number."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = Kept.of(state.get[0]) if state.exists else None
        out: list[tuple] = []
        if state.hasTimedOut:
            if kept and not kept.closed and (end or batch - kept.last >= silent):
                turns, missing, breaks = kept.close()
                out.append(("close", key[0], -1, batch, None, turns, missing, breaks))
        else:
            for rows in frames:
                own = list(zip(rows["turn"].tolist(), rows["role"].tolist(), rows["payload"].tolist(), strict=True))
                if kept and kept.closed:
                    out += [("reject", key[0], t, batch, p, None, None, None) for t, _, p in own]
                    continue
                kept = kept or Kept(int(rows["first"].iat[0]), batch)
                out += [("release", key[0], t, batch, p, None, None, None) for t, p in kept.arrive(batch, own)]
        state.update((kept.dump(),))
        if not kept.closed:
            state.setTimeoutDuration(1)  # over at the next start
        if out:  # most visits have nothing to say
            yield pd.DataFrame(dict(zip(COLUMNS, map(list, zip(*out, strict=True)), strict=True)), dtype=object)

    return run


def reassemble(arriving: DataFrame, batches: int = BATCHES, silent: int = SILENT) -> DataFrame:
    """Events of ``arriving`` (conv_id, turn, batch, role, payload, first), fed batch by batch to a stream with state.

    ``release``: a turn and its payload, once all turns from ``first`` on are released; of a turn's arrivals the
    earliest is kept.  ``close``: a conversation without arrivals in ``silent`` batches in a row (in the last of these),
    or at the end (batch number ``batches``), with its unreleased turns, the number of turns missing below the largest
    kept one, and of kept turns that repeat the role of the turn before.  ``reject``: an arrival after that.

    Every batch has a marker row, so that an empty one still starts the query and passes time.  A start ends only when
    its micro-batch is committed; if tasks or executors are lost in it, Spark runs them again from the checkpoint.
    State, input and events lie in a new folder below the shared one.  A conversation is one key of the state: what it
    keeps there are its unreleased turns.  An empty table gives no events.
    """
    spark = arriving.sparkSession
    root = new_path(spark, "turns")
    kind = arriving.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "role", "payload", "first"]
    dealt = Saved(spark, "arrivals").keep(arriving.select(*columns, F.col("batch").cast("int").alias("batch")), "batches", ["batch"])
    mark = spark.range(1).select(*[F.lit(None).cast(arriving.schema[c].dataType).alias(c) for c in columns])
    for batch in range(batches + 1):
        now = dealt.where(F.col("batch") == batch).select(*columns).unionByName(mark) if batch < batches else mark
        now.write.mode("append").parquet(f"{root}/inbox")
        turns = spark.readStream.schema(mark.schema).parquet(f"{root}/inbox").where("turn IS NOT NULL")
        events = turns.groupBy("conv_id").applyInPandasWithState(step(batch, batch == batches, silent), EVENTS.format(kind=kind), "kept string", "append", GroupStateTimeout.ProcessingTimeTimeout)
        started = events.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(once=True).start(f"{root}/events")
        started.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/events")


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reassemble(arrivals(table(spark, sf_dir, "conversations")))
    said = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.col("payload"))
    return events.select("event", F.sha2(said, 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")
