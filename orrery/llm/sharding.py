"""Sharding: a weighted hash tree of regions, racks and shards.

A row descends from the root: at each level every child draws ``-ln(u) / weight``, with u a hash of the row's id and the
child's name, and the smallest draw takes the row.  A draw depends on nothing but the id, the child and its weight, so
a child whose weight changes wins rows from its siblings or loses rows to them, and no row moves between two children
whose weights stay: movement is confined to the subtrees that changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import Saved, table

#: Shards of the cluster as it was planned: two regions of two racks with four shards each.
PLANNED, REGIONS, RACKS = 16, 2, 2


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard (a leaf, which has its number); an inner node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def leaves(self) -> list[int]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self.shard]


def tree(regions: Sequence[Sequence[Sequence[tuple[int, float]]]]) -> Node:
    """The tree of regions of racks of (shard, weight); a name is the path of positions, so it outlives changes elsewhere."""
    return Node("", tuple(Node(f"{i}", tuple(Node(f"{i}/{j}", tuple(Node(f"{i}/{j}/{s}", (), s, float(w)) for s, w in rack if w > 0)) for j, rack in enumerate(racks) if any(w > 0 for _, w in rack))) for i, racks in enumerate(regions) if any(w > 0 for rack in racks for _, w in rack)))


def layout(shards: int, planned: int = PLANNED, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """Shards of equal weight: the planned ones spread over regions and racks, each later one in a region of its own.

    So one more shard beyond the planned ones changes the weight of no subtree that was there, and takes rows only
    into itself; a planned shard that is missing takes none.
    """
    own = [[[(s, 1.0) for s in range(min(shards, planned)) if s * regions * racks // planned == i * racks + j] for j in range(racks)] for i in range(regions)]
    return tree([*own, *([[(s, 1.0)]] for s in range(planned, shards))])


def drawn(key: Column, child: Node) -> Column:
    """An exponential draw of rate ``weight``: the smallest of several is the child's with probability weight / sum of weights."""
    u = (F.pmod(F.xxhash64(key, F.lit(child.name)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    return -F.ln(u) / F.lit(child.weight)


def winner(key: Column, node: Node) -> Column:
    """Position of the child that takes the row; of equal draws the first."""
    if len(node.children) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(drawn(key, c).alias("draw"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]


def placed(df: DataFrame, root: Node, key: str, name: str) -> DataFrame:
    """``df`` with the shard of each row in column ``name``; three descents, each a draw among one node's children."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))

    def at(level: list[Node], position: Column) -> Column:
        out = None
        for i, node in enumerate(level):
            out = F.when(position == i, winner(k, node)) if out is None else out.when(position == i, winner(k, node))
        return out

    region, rack, shard = f"_{name}_region", f"_{name}_rack", f"_{name}_shard"
    racks = [x for r in root.children for x in r.children]
    first = {r.name: i for i, r in enumerate(racks)}
    df = df.withColumn(region, winner(k, root))
    df = df.withColumn(rack, at(list(root.children), F.col(region)) + F.element_at(F.array(*[F.lit(first[r.children[0].name]) for r in root.children]), F.col(region) + 1))
    df = df.withColumn(shard, at(racks, F.col(rack)))
    leaves = F.array(*[F.array(*[F.lit(s.shard) for s in r.children]) for r in racks])
    return df.withColumn(name, F.element_at(F.element_at(leaves, F.col(rack) + 1), F.col(shard) + 1)).drop(region, rack, shard)


def slotted(df: DataFrame, shard: str, order: Sequence[str], saved: Saved) -> DataFrame:
    """``df`` with ``slot``: the rank of a row within its shard by ``order``, gapless from 0.

    A shard is no group: rows are dealt by ranges of ``order`` (at last the row number of the scan, so that equal keys
    are spread too), counted for each range and shard, and ranked within one range of one shard.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_rid"]
    dealt = saved.keep(df.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    ranged = saved.keep(dealt.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    saved.drop(dealt)
    counts = ranged.groupBy("_range", shard).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range", shard).orderBy(*keys)) - 1
    return ranged.withColumn("_rank", rank).join(offsets, ["_range", shard]).withColumn("slot", F.col("_before") + F.col("_rank")).drop("_range", "_before", "_rank", "_rid")


def shard_rows(docs: DataFrame, now: Node, grown: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: doc_id, size (UTF-8 bytes of the text and 1), text_crc32, shard, slot (rank by id in its shard), grown_shard.

    ``shard`` is the row's leaf in the tree ``now``, ``grown_shard`` that in ``grown``; the id and the tree decide alone.
    A null id is a key of its own, a null or empty text has size 1 and crc 0.  Rows repeated with one id go to one
    shard and get slots of their own, in the order of the scan; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = placed(placed(rows, now, "doc_id", "shard"), grown, "doc_id", "grown_shard")
    return slotted(rows, "shard", ["doc_id"], Saved(docs.sparkSession, "shards"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), layout(16), layout(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
