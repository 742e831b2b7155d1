"""Inverted-file index over vectors: rows are dealt to the cell of their nearest centroid, a search reads the nearest cells."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from orrery.sources.shared import Saved, new_path, stamped_path

#: Centroids and the number of probes are learned from about so many rows, twice as many at most; all rows are indexed.
SAMPLE = 1 << 16
#: Cells: the root of the number of rows, so many at most, and centroids of so many bytes at most, since they are broadcast.
MAX_CELLS, CENTROID_BYTES = 1 << 12, 32 << 20
ROUNDS = 12
#: So many cells are probed that this share of the sample's true neighbours is found.
RECALL, TRIALS = 0.97, 512
#: Many queries meet the rows in blocks of about so many rows and queries, and so many bytes of either; small cells share a block, large ones are cut.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 1 << 14, 1 << 14, 32 << 20
#: So many scores are computed at once; so many finds at least wait until they are merged with the best ones.
SCORES, FINDS = 1 << 20, 1 << 18
#: Rows that a task searches at least, where there are tasks enough for all cores.
TASK_ROWS = 1 << 16
#: Number of the folders' layout; an index that an older layout has written is not opened.
FORMAT = 1
#: Queries of so many bytes at most go to the rows; more are shuffled with them.
QUERY_BYTES = 32 << 20
#: Tombstones that are broadcast at most.
BROADCAST_ROWS = 100_000


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors of length 1 as rows; shorter ones are padded with zeros, missing elements are 0, zero vectors stay zero."""
    out = np.zeros((len(vectors), width), np.float32)
    for i, v in enumerate(vectors):
        own = np.array(v, np.float32)
        if len(own) > width:
            raise ValueError(f"a vector of {len(own)} elements in an index of {width}")
        out[i, : len(own)] = own
    np.nan_to_num(out, copy=False)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def centroids_of(points: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly drawn points; a cell that runs empty keeps its centroid."""
    middle = points[np.linspace(0, len(points) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(points, middle, 1)[:, 0]
        sums = np.zeros_like(middle)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), middle)
    return middle


def nearest(points: np.ndarray, middle: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each point, the nearest first."""
    out = np.empty((len(points), n), np.int32)
    for a in range(0, len(points), 1024):
        score = points[a : a + 1024] @ middle.T
        out[a : a + 1024] = score.argmax(axis=1)[:, None] if n == 1 else np.argsort(-score, axis=1, kind="stable")[:, :n]
    return out


def probes_for(points: np.ndarray, middle: np.ndarray, k: int, recall: float) -> int:
    """The least number of probes that finds ``recall`` of the ``k`` other points nearest to each of up to TRIALS ``points``."""
    if len(points) < 2:
        return 1
    at = np.linspace(0, len(points) - 1, min(TRIALS, len(points))).astype(int)
    trial = points[at]
    own = nearest(points, middle, 1)[:, 0]
    order = nearest(trial, middle, len(middle))
    place = np.empty_like(order)  # of each cell in a trial's order
    np.put_along_axis(place, order, np.arange(len(middle), dtype=np.int32)[None, :], axis=1)
    k, needed = min(k, len(points) - 1), []
    for a in range(0, len(trial), 64):
        score = trial[a : a + 64] @ points.T
        np.put_along_axis(score, at[a : a + 64, None], -np.inf, axis=1)
        found = np.argpartition(-score, k - 1, axis=1)[:, :k]
        needed.append(np.take_along_axis(place[a : a + 64], own[found], axis=1).ravel())
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``root``: rows (key, vector) in folders by segment and cell, and what a search has to know.

    ``dead``: segments with tombstones, which hide their keys in older segments.
    """

    spark: SparkSession
    root: str
    key: str
    vector: str
    schema: StructType
    centroids: np.ndarray
    probes: int
    segments: tuple[int, ...] = (1,)
    dead: tuple[int, ...] = ()
    n_dead: int = 0

    def _folder(self, kind: str, segments: tuple[int, ...], schema: StructType) -> DataFrame:
        full = StructType([*schema.fields, StructField("segment", IntegerType())])
        if not segments:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.root}/{kind}/segment={i}" for i in segments]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def read(self, cells: list[int] | None = None) -> DataFrame:
        """Live rows (key, vector, cell), of all cells or of these, whose folders alone are read."""
        rows = self._folder("rows", self.segments, StructType([*self.schema.fields, StructField("cell", IntegerType())]))
        rows = rows if cells is None else rows.where(F.col("cell").isin(cells))
        if not self.dead:
            return rows.drop("segment")
        dead = self._folder("dead", self.dead, StructType([self.schema[self.key]])).groupBy(F.col(self.key).alias("_key")).agg(F.max("segment").alias("_until"))
        dead = F.broadcast(dead) if self.n_dead <= BROADCAST_ROWS else dead
        hidden = F.col("_until").isNotNull() & (F.col("segment") < F.col("_until"))
        return rows.join(dead, F.col(self.key) == F.col("_key"), "left").where(~hidden).drop("_key", "_until", "segment")

    def held(self) -> np.ndarray:
        """Rows written to each cell, those that are hidden by now among them."""
        out = np.zeros(len(self.centroids), np.int64)  # MAX_CELLS at most
        sizes = self._folder("sizes", self.segments, StructType([StructField("cell", IntegerType()), StructField("n_rows", LongType())]))
        for r in sizes.groupBy("cell").agg(F.sum("n_rows").alias("n")).collect():
            out[r["cell"]] = r["n"]
        return out

    def write(self, rows: DataFrame, segment: int) -> None:
        """Deal rows to their cells' folders; large cells are split over files."""
        width, vector = self.centroids.shape[1], self.vector
        sent = self.spark.sparkContext.broadcast(self.centroids)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(cell=nearest(matrix(b[vector], width), sent.value, 1)[:, 0] if len(sent.value) else np.zeros(len(b), np.int32))

        dealt = rows.select(self.key, self.vector).mapInPandas(deal, StructType([*self.schema.fields, StructField("cell", IntegerType())]))
        to = f"{self.root}/rows/segment={segment}"
        dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(to)  # a failed writer may have left something there
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField("cell", IntegerType())])).parquet(to)
        written.groupBy("cell").agg(F.count("*").alias("n_rows")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sizes/segment={segment}")  # MAX_CELLS rows at most

    def refresh(self, changed: DataFrame, removed: DataFrame) -> VectorIndex:
        """The index with rows that are new or changed, without keys that are removed; the older one stays readable.

        Only the changes are written: tombstones and a segment, dealt by the centroids that the index has.  A changed
        row without a vector is removed.  A key that is changed and removed is changed; keys of ``changed`` are unique.
        """
        segment = max(self.segments) + 1
        touched = changed.select(self.key).unionByName(removed.select(self.key)).distinct()
        touched.write.parquet(f"{self.root}/dead/segment={segment}")
        n = self.spark.read.parquet(f"{self.root}/dead/segment={segment}").count()
        self.write(changed.where(F.col(self.vector).isNotNull()), segment)
        out = replace(self, segments=(*self.segments, segment), dead=(*self.dead, segment), n_dead=self.n_dead + n)
        return out._save()

    def compact(self) -> VectorIndex:
        """All live rows in one segment."""
        segment = max(self.segments) + 1
        self.write(self.read(), segment)
        return replace(self, segments=(segment,), dead=(), n_dead=0)._save()

    def _save(self) -> VectorIndex:
        facts = {"key": self.key, "vector": self.vector, "schema": self.schema.json(), "probes": self.probes, "segments": list(self.segments), "dead": list(self.dead), "n_dead": self.n_dead, "width": int(self.centroids.shape[1])}
        row = [(json.dumps(facts), bytearray(self.centroids.astype(np.float32).tobytes()))]
        self.spark.createDataFrame(row, "facts string, centroids binary").coalesce(1).write.parquet(f"{self.root}/versions/version={max(self.segments)}")
        return self


def opened(spark: SparkSession, root: str, version: int | None = None) -> VectorIndex:
    """The index below ``root``: its last version, or an older one by the number of its last segment."""
    known = spark.read.parquet(f"{root}/versions")
    known = known if version is None else known.where(F.col("version") == version)
    row = known.orderBy(F.desc("version")).first()  # one row a version
    if row is None:
        raise ValueError(f"no version {version} of {root}")
    f = json.loads(row["facts"])
    middle = np.frombuffer(bytes(row["centroids"]), np.float32).reshape(-1, f["width"])
    return VectorIndex(spark, root, f["key"], f["vector"], StructType.fromJson(json.loads(f["schema"])), middle, f["probes"], tuple(f["segments"]), tuple(f["dead"]), f["n_dead"])


def build(df: DataFrame, key: str, vector: str, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, root: str | None = None) -> VectorIndex:
    """Index all rows of ``df`` whose vector is not null by cosine; keys are unique.  An empty table gives an empty index.

    The width is that of the sample's longest vector; a longer one elsewhere is refused.  No shuffle but that which
    deals rows to files by cell, in which Spark splits large cells.  The index lies below ``root``, or a new folder of
    the shared one, until that is deleted; ``opened`` finds it again.
    """
    spark, rows = df.sparkSession, df.where(F.col(vector).isNotNull()).select(key, vector)
    n = rows.count()
    drawn = (rows.sample(fraction=sample / n, seed=17) if n > sample else rows).select(vector).limit(2 * sample).toPandas()[vector]
    width = max((len(v) for v in drawn), default=1)
    points = np.unique(matrix(drawn, width), axis=0)  # copies would count as neighbours that are easily found
    cells = max(1, min(MAX_CELLS, isqrt(n), CENTROID_BYTES // (4 * max(1, width)), max(1, len(points))))
    middle = centroids_of(points, cells) if len(points) else np.zeros((0, width), np.float32)
    probes = probes_for(points, middle, k, recall) if len(points) else 1
    index = VectorIndex(spark, root or new_path(spark, "vector-index"), key, vector, rows.schema, middle, probes)
    index.write(rows, 1)
    return index._save()


def kept(df: DataFrame, name: str, key: str, vector: str) -> VectorIndex:
    """The index of a table as its files are now: opened if an earlier call has built it, built if not."""
    root = stamped_path(df, f"vectors-{name}", [FORMAT, key, vector])
    try:
        return opened(df.sparkSession, root)
    except AnalysisException:  # nothing there
        return build(df, key, vector, root=root)


class Best:
    """The ``k`` rows of most cosine for each query, among rows that come cell by cell: so many a query are held, however many come.

    Single precision tells which rows may be among the best, double precision ranks them, so that neither the order in which
    rows come nor the size of a block moves a score; ties go by key.
    """

    def __init__(self, q: np.ndarray, masks: pd.Series | np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.masks = np.frombuffer(b"".join(masks), np.uint8).reshape(len(q), -1) if len(q) else None
        self.slack = (q.shape[1] + 4) * np.finfo(np.float32).eps  # over the error of a score in single precision
        self.least = np.full(len(q), -np.inf)  # a row below is not among a query's best
        self.held: tuple[np.ndarray, ...] = ()  # place of the query, key, score
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, rows: pd.DataFrame) -> None:
        """Rows (key, v, cell)."""
        for cell, own in rows.groupby("cell"):
            at = np.flatnonzero(self.masks[:, cell >> 3] & (128 >> (cell & 7)))
            if len(at):
                own = own.sort_values("key", na_position="first")
                self._score(at, own["key"].to_numpy(), matrix(own["v"], self.q.shape[1]))

    def _score(self, at: np.ndarray, keys: np.ndarray, v: np.ndarray) -> None:
        k = self.k
        few = pd.Series([r.tobytes() for r in v])
        few = few.groupby(few).cumcount().to_numpy() < k  # of equal vectors those of the first keys
        keys, v = keys[few], v[few]
        step = max(1, SCORES // len(v))
        for a in range(0, len(at), step):
            own = at[a : a + step]
            score = self.q[own] @ v.T
            floor = self.least[own] - self.slack
            new = np.flatnonzero(np.isneginf(floor))
            if len(new) and len(v) > k:
                floor[new] = np.partition(score[new], -k, axis=1)[:, -k] - 2 * self.slack
            i, j = np.nonzero(score >= floor.astype(np.float32)[:, None])
            exact, size = np.empty(len(i)), max(1, SCORES // self.q.shape[1])
            for b in range(0, len(i), size):
                exact[b : b + size] = np.einsum("ij,ij->i", self.q[own[i[b : b + size]]], v[j[b : b + size]], dtype=np.float64)
            i, j, exact, last = _cut(i, j, exact, k)
            self.least[own[i[last]]] = np.maximum(self.least[own[i[last]]], exact[last])
            self.found.append((own[i], keys[j], exact))
            self.waiting += len(i)
            if self.waiting > max(FINDS, k * len(self.q)):
                self._merge()

    def _merge(self) -> None:
        parts = [self.held, *self.found] if self.held else self.found
        at, key, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        may = score >= self.least[at]
        at, key, score, last = _cut(at[may], key[may], score[may], self.k)
        self.least[at[last]] = score[last]
        self.held, self.found, self.waiting = (at, key, score), [], 0

    def rows(self, asks: np.ndarray) -> Iterator[pd.DataFrame]:
        if self.found:
            self._merge()
        if self.held:
            at, key, score = self.held
            yield pd.DataFrame({"query": asks[at], "key": key, "score": score})


def _cut(at: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each query by score, then key (null first), in this order, and where the ``k``-th stand."""
    order = np.lexsort((pd.factorize(key, sort=True)[0] if key.dtype.kind in "Of" else key, -score, at))
    at = at[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    own = place < k
    order = order[own]
    return at[own], key[order], score[order], np.flatnonzero(place[own] == k - 1)


def _blocks(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells in a row share one, a large one has several of its own."""
    first, parts, block, room = np.zeros(len(held), np.int64), np.maximum(1, -(-held // size)), 0, size
    for cell, n in enumerate(held):  # MAX_CELLS at most
        if n > room:
            block, room = block + (room < size), size
        first[cell] = block
        block, room = (block + parts[cell], size) if parts[cell] > 1 else (block, room - n)
    return first, parts


def _by_map(live: DataFrame, asked: pd.DataFrame, width: int, k: int, schema: StructType) -> DataFrame:
    """Few queries go to the rows: each task gives its best rows for each query, whatever cells it has read.

    So no vector of the index is shuffled.  The caller has checked what the queries and their best rows take.
    """
    sent = live.sparkSession.sparkContext.broadcast((matrix(asked["q"], width), asked["mask"].to_numpy(), asked["query"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, masks, asks = sent.value
        best = Best(q, masks, k)
        for b in batches:
            best.add(b)
        yield from best.rows(asks)

    return live.mapInPandas(run, schema)


def search(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query, key, score, rank): the ``k`` rows of most cosine in the probed cells, ties by key; query keys are unique.

    A query probes further while its cells hold fewer than ``k`` rows.  Null query vectors find nothing, an empty index
    holds nothing, a query wider than the index is refused.  Few queries go to the tasks that read the cells; many meet the rows in
    blocks of both.  A task or block gives its best ``k`` for each query, not each cell, and these are ranked together.
    """
    probes, width = min(probes or index.probes, len(index.centroids)), index.centroids.shape[1]
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("query"), F.col(vector).alias("q"))
    schema = StructType([asked.schema["query"], StructField("key", index.schema[index.key].dataType)]).add("score", "double")
    if not probes:
        return queries.sparkSession.createDataFrame([], StructType([*schema.fields, StructField("rank", IntegerType())]))
    held, spark = index.held(), queries.sparkSession
    first, parts = _blocks(held, max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * width))))
    sent = spark.sparkContext.broadcast((index.centroids, held, first, parts))
    slack = index.n_dead  # so many of the rows in a query's cells may be hidden

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle, sizes, first, parts = sent.value
        for b in batches:
            order = nearest(matrix(b["q"], width), middle, len(middle))
            short = (np.cumsum(sizes[order], axis=1) < k + slack).sum(axis=1)  # cells that hold fewer than k rows together
            asks, blocks = np.zeros(order.shape, bool), []
            for i, n in enumerate(short):
                own = order[i, : max(probes, n + 1)]
                asks[i, own] = True
                n = parts[own]
                blocks.append(np.unique(np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())))
            yield b.assign(mask=[m.tobytes() for m in np.packbits(asks, axis=1)], blocks=blocks)

    def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"mask": [np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in b["mask"]]).tobytes()]})

    saved = Saved(spark, "vector-search")
    probed = asked.mapInPandas(probe, StructType([*asked.schema.fields, StructField("mask", BinaryType())]).add("blocks", ArrayType(LongType())))
    probed = saved.keep(probed, "probed")
    n_asked = probed.count()
    # folders of cells that no query probes are not read; a batch of queries sends a bit for each cell
    masks = [np.frombuffer(r[0], np.uint8) for r in probed.select("mask").mapInPandas(union, "mask binary").collect()]
    cells = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(masks))[: len(held)]).tolist() if masks else []
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    live = index.read(cells).select(F.col(index.key).alias("key"), F.col(index.vector).alias("v"), "cell")
    if n_asked * (4 * width + len(held) // 8 + 24 * k) <= QUERY_BYTES:
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(held[cells].sum()) // TASK_ROWS)
        found = _by_map(live.coalesce(tasks), probed.select("query", "q", "mask").toPandas(), width, k, schema)
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
    lots = -(-n_asked // max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (4 * width))))
    blocks_of = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, parts, strict=True))], "cell int, first bigint, parts bigint")
    block = F.col("first") + F.pmod(F.xxhash64("key"), "parts")
    rows = live.join(F.broadcast(blocks_of), "cell").select("key", "v", "cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    near = probed.select("query", "q", "mask", F.explode("blocks").alias("block"), F.pmod(F.xxhash64("query"), F.lit(lots)).cast("int").alias("lot"))
    by = ["block", "lot"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = Best(matrix(right["q"], width), right["mask"], k)
        if len(right):
            best.add(left)
        return next(best.rows(right["query"].to_numpy()), pd.DataFrame({"query": [], "key": [], "score": []}))

    found = rows.groupBy(*by).cogroup(near.groupBy(*by)).applyInPandas(meet, schema)
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
