"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Forward Viterbi over four grammar states (nothing yet, after system, after user, after assistant).  A state carries the
least (cost, audit) with which it can be reached; a turn's layer is closed by insert transitions, of which three suffice
for four states.  The grammar is deterministic: from a state, the letters of an audit fix the roles.

Audits are compared without being copied: all audits of a layer end in the same number of turn letters, so none is a
proper prefix of another, their order never changes by what follows, and a rank stands for each.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks.  What a task
has of a conversation that may go on elsewhere becomes a piece: least costs and audits from each state to each.  Pieces
are composed in order, and the repaired texts of such conversations, whose digest can't be composed, are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import SPACE_CHARS, Saved, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn that is given the only role the grammar takes next (reroled or inserted), and that role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: State after keeping a turn of this role initial; other pairs are illegal.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
FINAL = (START, ASSISTANT)
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Turns after which an audit's common beginning is set aside.
SETTLE = 512

ORDER = ["conv_id", "turn", "role", "text"]
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
PIECE = "conv_id {kind}, piece int, edge boolean, n bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, paths array<struct<entry:int,exit:int,cost:bigint,audit:string>>, cost bigint, audit string, sha256 string"
RESULT = "conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id {kind}, repaired_sha256 string"


class Repair:
    """All best paths from one entry state over the turns seen so far."""

    def __init__(self, entry: int = START) -> None:
        self.settled: list[str] = []
        self.n = 0
        # state -> ((cost, rank, inserts since the last turn), audit as a linked list, digest of the repaired turns)
        self.live: dict[int, tuple] = {entry: ((0, 0, ""), None, hashlib.sha256())}

    @staticmethod
    def emit(digest: Any, state: int, role: str, text: str) -> Any:
        new = digest.copy()
        new.update(f"{'' if state == START else chr(10)}{role}:{text}".encode())
        return new

    def close(self) -> None:
        """Insert transitions until nothing gets cheaper."""
        for _ in range(3):
            for state, ((cost, rank, tail), audit, digest) in list(self.live.items()):
                to, key = NEXT[state], (cost + INSERT_COST, rank, tail + "I")
                if to not in self.live or key < self.live[to][0]:
                    self.live[to] = (key, audit, self.emit(digest, state, ROLE[to], ""))

    def turn(self, role: str, text: str, fault: int) -> None:
        self.close()
        found: dict[int, tuple] = {}
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, ((cost, rank, tail), _, _) in self.live.items():
            options = [("D", state, DELETE_COST)]
            if fault not in (BLANK, DUPLICATE):
                options.append(("R", NEXT[state], REROLE_COST + extra))
                if (kept := KEEP.get((state, role[:1]))) is not None:
                    options.append(("K", kept, extra))
            for letter, to, price in options:
                key = (cost + price, rank, tail + letter)
                if to not in found or key < found[to][0]:
                    found[to] = (key, state, letter)
        rank_of = {k: i for i, k in enumerate(sorted({f[0][1:] for f in found.values()}))}
        live = {}
        for to, (key, state, letter) in found.items():
            _, audit, digest = self.live[state]
            new = digest if letter == "D" else self.emit(digest, state, role if letter == "K" else ROLE[to], text)
            live[to] = ((key[0], rank_of[key[1:]], ""), (audit, key[2]), new)
        self.live = live
        self.n += 1
        if self.n % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        """Set the common beginning of all audits aside."""
        texts = {s: self.text(v[1]) for s, v in self.live.items()}
        low, high = min(texts.values()), max(texts.values())
        k = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        self.settled.append(low[:k])
        self.live = {s: (key, (None, texts[s][k:]), digest) for s, (key, _, digest) in self.live.items()}

    @staticmethod
    def text(audit: tuple | None) -> str:
        parts = []
        while audit:
            audit, letters = audit
            parts.append(letters)
        return "".join(reversed(parts))

    def paths(self) -> dict[int, tuple[int, str]]:
        """state -> (cost, audit) right after the last turn, nothing inserted since."""
        done = "".join(self.settled)
        return {s: (key[0], done + self.text(audit)) for s, (key, audit, _) in self.live.items()}

    def best(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired turns) of the best legal path."""
        self.close()
        key, audit, digest = min((self.live[s] for s in FINAL if s in self.live), key=lambda v: v[0])
        return key[0], "".join(self.settled) + self.text(audit) + key[2], digest.hexdigest()


def composed(pieces: list[list[dict]]) -> tuple[int, str]:
    """(cost, audit) of the best legal path through the pieces of one conversation, in order."""
    now = {START: (0, "")}
    for paths in pieces:
        new: dict[int, tuple[int, str]] = {}
        for p in paths:
            if p["entry"] in now:
                cost, audit = now[p["entry"]]
                path = (cost + p["cost"], audit + p["audit"])
                if p["exit"] not in new or path < new[p["exit"]]:
                    new[p["exit"]] = path
        now = new
    for _ in range(3):
        for state, (cost, audit) in list(now.items()):
            path = (cost + INSERT_COST, audit + "I")
            if NEXT[state] not in now or path < now[NEXT[state]]:
                now[NEXT[state]] = path
    return min(now[s] for s in FINAL if s in now)


class Piece:
    """What a task has seen of one conversation; ``entries`` are the states in which it may begin."""

    def __init__(self, conv: Any, entries: tuple[int, ...]) -> None:
        self.conv, self.repairs = conv, {e: Repair(e) for e in entries}
        self.n = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = self.before = None
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        """``fault`` says DUPLICATE for a text seen at an earlier turn; a repeat at the same turn is next to its like."""
        if fault != BLANK and self.before == (turn, role, text):
            fault = DUPLICATE
        self.before = (turn, role, text)
        if fault != OK:
            self.counts[COUNTS[fault - 1]] += 1
        if self.n and self.last_initial + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.first_initial = role[:1] if not self.n else self.first_initial
        self.last_initial = role[:1]
        self.n += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        for r in self.repairs.values():
            r.turn(role, text, fault)

    def row(self, number: int, edge: bool) -> dict:
        out = {"conv_id": self.conv, "piece": number, "edge": edge, "n": self.n, "turns": self.turns, **self.counts}
        out |= {c: getattr(self, c) for c in ("first_turn", "last_turn", "first_initial", "last_initial")}
        if edge:
            out["paths"] = [{"entry": e, "exit": x, "cost": c, "audit": a} for e, r in self.repairs.items() for x, (c, a) in r.paths().items()]
        out["cost"], out["audit"], out["sha256"] = self.repairs[START].best()
        return out


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def arrow_schema(ddl: str, kind: pa.DataType, columns: tuple[str, ...]) -> pa.Schema:
    """The Arrow side of a result: conv_id of its own kind, the rest by name."""
    path = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    own = {"conv_id": kind, "piece": pa.int32(), "edge": pa.bool_(), "paths": path, "audit": pa.string(), "sha256": pa.string(), "repaired_sha256": pa.string(), "first_initial": pa.string(), "last_initial": pa.string()}
    return pa.schema([(c, own.get(c, pa.int64())) for c in columns])


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a task's sorted rows; the first and the last may go on in other tasks."""
    number, now, rows, schema = TaskContext.get().partitionId(), None, [], None
    columns = tuple(c.split()[0] for c in PIECE.split(", "))
    for b in batches:
        schema = schema or arrow_schema(PIECE, b.column(0).type, columns)
        for conv, group in groupby(zip(*[c.to_pylist() for c in b.columns], strict=True), key=lambda r: r[0]):
            if now is None:
                now = Piece(conv, (START, SYSTEM, USER, ASSISTANT))
                first = now
            elif conv != now.conv:
                rows.append(now.row(number, now is first))
                now = Piece(conv, (START,))
            for _, turn, role, text, alive, fault in group:
                if alive:
                    now.add(turn, role, text, fault)
        if len(rows) >= 1000:
            yield batch_of(rows, schema)
            rows = []
    if now is not None:
        yield batch_of([*rows, now.row(number, True)], schema)


def joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation as one result; the digest only if there is one piece."""
    parts = pieces.sort_values("piece").to_dict("records")
    real = [p for p in parts if p["n"]]
    out = {"conv_id": parts[0]["conv_id"], **{c: sum(p[c] for p in parts) for c in COUNTS}}
    out["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(real, real[1:], strict=False))
    dated = [p for p in real if p["turns"]]
    same = sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
    out["gaps"] = int(dated[-1]["last_turn"]) - int(dated[0]["first_turn"]) + 1 - (sum(p["turns"] for p in dated) - same) if dated else 0
    if len(parts) == 1:
        out |= {"cost": parts[0]["cost"], "audit": parts[0]["audit"], "repaired_sha256": parts[0]["sha256"]}
    else:
        cost, audit = composed([list(p["paths"]) for p in parts])
        out |= {"cost": cost, "audit": audit, "repaired_sha256": None}
    return pd.DataFrame([out])[["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]].astype({"conv_id": object})


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of repaired conversations whose sorted rows stream by, each behind its audit; holds one turn at a time."""
    rows: list[dict] = []
    schema = conv = audit = None
    at = state = 0
    digest: Any = None

    def inserts() -> None:
        nonlocal at, state, digest
        while at < len(audit) and audit[at] == "I":
            digest, state, at = Repair.emit(digest, state, ROLE[NEXT[state]], ""), NEXT[state], at + 1

    for b in batches:
        schema = schema or arrow_schema(REPAIRED, b.column(0).type, ("conv_id", "repaired_sha256"))
        for row_conv, _, role, text, given in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if given is not None:
                if audit is not None:
                    inserts()
                    rows.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                conv, audit, at, state, digest = row_conv, given, 0, START, hashlib.sha256()
                continue
            inserts()
            letter, at = audit[at], at + 1
            if letter != "D":
                to = NEXT[state] if letter == "R" else KEEP[state, role[:1]]
                digest, state = Repair.emit(digest, state, ROLE[to] if letter == "R" else role, text), to
    if audit is not None:
        inserts()
        yield batch_of([*rows, {"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive) of the turns after the contract's damage; a dropped one stays as not alive.

    A null role or text, and a null conv_id or turn in the hashed key, is one space.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    c = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    text = F.when(c == 1, "").when(c == 2, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    copies = F.when(c == 0, F.array(F.lit(False))).when(c == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(c == 4, "user").otherwise(own("role")).alias("role"), text.alias("text"), F.explode(copies).alias("alive"))


def faulty(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault``: blank, a text and role that an earlier turn has, or truncated.

    Only texts that repeat within their conversation are joined, and they are counted before they are shuffled.
    """
    end = F.rtrim("text", F.lit(SPACE_CHARS))
    own = turns.withColumn("_end", F.right(end, F.lit(1))).withColumn("_key", F.when(F.col("alive") & (F.col("_end") != ""), F.md5("text")))
    same = own.where("_key IS NOT NULL").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_key").alias("_k"))
    repeats = same.agg(F.count("*").alias("_n"), F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_undated")).where("_n > 1").drop("_n")
    met = own.join(repeats, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_key") == F.col("_k")), "left")
    late = F.col("_k").isNotNull() & F.col("turn").isNotNull() & (F.col("_undated") | (F.col("turn") > F.col("_first")))
    fault = F.when(F.col("_end") == "", BLANK).when(late, DUPLICATE).when(~F.col("_end").isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    return met.select(*ORDER, "alive", fault.alias("fault"))


def repair(turns: DataFrame) -> DataFrame:
    """Of each conversation of ``turns`` (conv_id, turn, role, text, alive): faults, least cost, audit, digest of the repair.

    Rows go by turn, nulls first, then by role and text.  A conversation without rows that are alive has zeros, an empty
    audit and the digest of nothing.  A null conv_id is a conversation of its own, null turns count for no gap, roles
    other than s.., u.. and a.. can't be kept.  Repeated rows are duplicates.  An empty table gives no rows.
    """
    spark = turns.sparkSession
    saved = Saved(spark, "repair")
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = saved.keep(faulty(turns), "turns")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    pieces = saved.keep(dealt.mapInArrow(pieces_of, PIECE.format(kind=kind)), "pieces")
    result = RESULT.format(kind=kind)
    # whole in one task: the greater part; the others have at most two pieces for each task
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.where(~F.col("edge")).select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", F.col("sha256").alias("repaired_sha256"))
    edges = saved.keep(pieces.where("edge").groupBy("conv_id").applyInPandas(joined, result), "edges")
    open_ = edges.where("repaired_sha256 IS NULL").select("conv_id", "audit")
    split = rows.where("alive").join(open_.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    behind = open_.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", F.lit(0).alias("_rank"))
    stream = behind.unionByName(split.select(*ORDER, F.lit(None).cast("string").alias("audit"), F.lit(1).alias("_rank")))
    stream = stream.repartition(n, "conv_id").sortWithinPartitions("conv_id", "_rank", "turn", "role", "text").select(*ORDER, "audit")
    digests = stream.mapInArrow(applied, REPAIRED.format(kind=kind)).select(F.col("conv_id").alias("_c"), F.col("repaired_sha256").alias("_sha"))
    put = edges.join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return whole.unionByName(put.select("conv_id", "gaps", *COUNTS, "cost", "audit", F.coalesce("repaired_sha256", "_sha").alias("repaired_sha256")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
