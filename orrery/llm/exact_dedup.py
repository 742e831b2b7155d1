"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Pass one reads each text once, keeps its SHA-256 in a narrow saved table, and counts the bits of a Bloom filter up
to two: ``once`` and ``twice``.  A text that occurs twice has set each of its bits twice, so in pass two a row can
only be repeated if all its bits are in ``twice``.  Only such rows are grouped; the rest pass straight through.

A filter has at most ``MAX_BITS`` bits, which bounds what is broadcast.  More rows than fit are dealt by hash into
rounds (folders of the saved table), each with a filter of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import SPACE, Saved, table

BITS_PER_ROW, PROBES = 16, 4
#: 32 MB a filter: the bound of what is broadcast.
MAX_BITS = 1 << 28
#: Bytes of the filter that are merged by one row of the first pass.
SLICE = 1 << 16
#: A group with more than this share of all rows is hot; there can be at most 1 / HOT such groups.
HOT = 1 / 1000


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, one row for each probe: double hashing of 64-bit hashes."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def set_bits(filter_: np.ndarray, positions: np.ndarray) -> None:
    """OR sorted bit positions into packed bytes."""
    if len(positions):
        byte, first = np.unique(positions >> 3, return_index=True)
        filter_[byte] |= np.bitwise_or.reduceat((1 << (positions & 7)).astype(np.uint8), first)


def has_bits(filter_: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (filter_[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def count_bits(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    """Count the bits of some rows; bits beyond the first time go to ``twice``."""
    at, n = np.unique(probes(hashes, len(once) * 8).ravel(), return_counts=True)
    set_bits(twice, at[(n > 1) | has_bits(once, at)])
    set_bits(once, at)


def repeated_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The ``twice`` filter of a column of 64-bit hashes."""
    size = bits // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for b in batches:
            count_bits(once, twice, b.column(0).to_numpy())
        for at in range(0, size, SLICE):
            part = once[at : at + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"slice": at // SLICE, "once": zlib.compress(part, 1), "twice": zlib.compress(twice[at : at + SLICE], 1)}])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row in b.to_pylist():
                o, t = (np.frombuffer(zlib.decompress(row[k]), np.uint8).copy() for k in ("once", "twice"))
                if row["slice"] in found:
                    once, twice = found[row["slice"]]
                    twice |= t | (once & o)
                    once |= o
                else:
                    found[row["slice"]] = o, t
        for k, (_, twice) in found.items():
            yield pa.RecordBatch.from_pylist([{"slice": k, "twice": zlib.compress(twice, 1)}])

    parts = keys.mapInArrow(build, "slice bigint, once binary, twice binary").repartition(max(1, min(64, size // SLICE)), "slice")
    out = np.zeros(size, np.uint8)
    for row in parts.mapInArrow(merge, "slice bigint, twice binary").collect():  # at most MAX_BITS / 8 bytes
        part = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return out


def flagged(keys: DataFrame, filter_: np.ndarray) -> DataFrame:
    """``keys`` with ``maybe``: can the row be repeated?"""
    sent = keys.sparkSession.sparkContext.broadcast(filter_)
    bits = len(filter_) * 8

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = has_bits(sent.value, probes(b.column(2).to_numpy(), bits)).all(axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maybe)], ["doc_id", "text_sha256", "maybe"])

    kind = keys.schema["doc_id"].dataType.simpleString()
    return keys.select("doc_id", "text_sha256", "h").mapInArrow(test, f"doc_id {kind}, text_sha256 string, maybe boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.  Of
    equal texts the smallest doc_id stays; null ids come last (if all are null, keep_id is null and all are kept).
    Rows repeated with one doc_id are one document: they count in group_size and share its verdict.  An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    saved = Saved(spark, "exact-dedup")
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", " ")
    keys = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256"))
    keys = saved.keep(keys, "hashes")
    n = keys.count()
    bits = 1 << max(SLICE.bit_length() + 2, (max(1, n) * BITS_PER_ROW - 1).bit_length())
    rounds = max(1, bits // max_bits)
    if rounds > 1:
        bits = max_bits
        dealt = saved.keep(keys.withColumn("round", F.pmod(F.shiftright("h", 40), F.lit(rounds)).cast("int")), "rounds", ["round"])
        saved.drop(keys)
        keys = dealt
    parts = []
    for r in range(rounds):
        own = keys.where(F.col("round") == r) if rounds > 1 else keys
        parts.append(saved.keep(flagged(own, repeated_filter(own.select("h"), bits)), "flagged"))
    saved.drop(keys)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    single = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = rows.where("maybe").select("doc_id", "text_sha256")
    groups = saved.keep(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    is_hot = F.col("group_size") > max(1, n * HOT)
    hot = groups.where(is_hot)  # at most 1 / HOT rows, so it may be broadcast
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    joined = maybe.join(F.broadcast(hot), "text_sha256", "left")
    of_hot = joined.where(F.col("group_size").isNotNull()).select(columns)
    of_rest = joined.where(F.col("group_size").isNull()).select("doc_id", "text_sha256").join(groups.where(~is_hot), "text_sha256").select(columns)
    out = single.unionByName(of_hot).unionByName(of_rest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
