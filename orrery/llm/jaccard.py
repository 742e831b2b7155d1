"""N-gram Jaccard join: parity sketches, pigeonhole blocks for each size band, exact verification.

Two sets of which the smaller has a elements and whose similarity is at least t differ in at most d = a (1 - t) / t
elements.  Dealt over d + 1 + m blocks by hash, at least m + 1 blocks then are equal in both.  A block is written as the
XOR of its elements' 64-bit hashes: its parity sketch.  Each set gives the keys of its d + 1 fullest blocks (in order of
size, then sketch, then number): the last in this order of the m + 1 equal blocks has at least m blocks below it in
either set, so both give it.  Blocks with hardly an element, which unlike sets would share, are thus not needed.
Sizes fall into bands, such that linked sets lie in the same or in neighbouring bands; a set gives the keys of its own
band's scheme and of the next lower one's.

Sets that share a block are candidates.  Pairs are never expanded: a block's sets form a star around one of them,
first within a scan task, then of the tasks' centres.  A candidate passes if the Hamming distance of the whole sets'
parity sketches, a lower bound of their symmetric difference, is not over d, and is then verified on the sets.

Similarity is not transitive, so a star whose rays did not all link may hide links between its outer sets.  Blocks
whose sets still lie in several components are therefore taken up again: first a spanning forest, then all of the
pairs across components whose sketches pass are verified, so no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import Saved, integral_id, table
from orrery.llm.components import components

U = np.uint64
#: Block keys that a scan task gathers before it writes, and that a bucket of the block join has on average.
FLUSH_KEYS, BUCKET_KEYS = 1 << 19, 1 << 20
MIN_BUCKETS = 64
#: Ids up to so many are broadcast to fetch texts (32 MB); more go through a shuffle.
BROADCAST_IDS = 1 << 21
#: A class of equal sets with more than this share of the rows is hot.
HOT = 1 / 1000
#: Sets of a block that are compared in one task; larger blocks are dealt over pairs of chunks.
CHUNK = 4096


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a whole text; with fewer words the whole as one."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(_WORDS.__getitem__, words), U, n)
        if n < width:
            one = U(n)
            for x in h:
                one = mixed(np.array([one * U(0x9E3779B97F4A7C15) + x], U))[0]
            return np.array([one], U)
        out = h[: n - width + 1].copy()
        for i in range(1, width):
            out = out * U(0x9E3779B97F4A7C15) + mixed(h[i : n - width + 1 + i] + U(i))
        return np.unique(mixed(out))


class Scheme:
    """Bands and blocks for similarity ``num / den`` and more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = [1]

    def differ(self, n: int | np.ndarray) -> int | np.ndarray:
        """Most elements in which a set of ``n`` and a linked one that is no smaller differ."""
        return n * (self.den - self.num) // self.num

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * self.den // self.num + 1))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def blocks(self, band: int) -> int:
        """Keys that a set gives in a band's scheme: one more than sets linked there may differ in."""
        self.band(self.low[min(band, len(self.low) - 1)])
        while len(self.low) < band + 2:
            self.band(self.low[-1])
        return self.differ(self.low[band + 1] - 1) + 1

    def keys(self, set_: np.ndarray) -> np.ndarray:
        """The block keys of a set (sorted hashes); none if only equal sets can link with it."""
        band = self.band(len(set_))
        out = [block_keys(set_, b, k) for b in (band, band - 1) if b >= 0 and (k := self.blocks(b)) > 1]
        return np.concatenate(out) if out else np.empty(0, U)


def block_keys(set_: np.ndarray, band: int, n_keys: int) -> np.ndarray:
    """Hashed parity sketches of the ``n_keys`` fullest of a third more blocks."""
    n_blocks = n_keys + n_keys // 3
    block = ((set_ >> U(32)) * U(n_blocks)) >> U(32)
    start = np.searchsorted(block, np.arange(n_blocks + 1, dtype=U))
    sketch = np.bitwise_xor.reduceat(np.append(set_, U(0)), start[:-1])
    size = np.diff(start)
    sketch[size == 0] = 0
    chosen = np.lexsort((sketch, size))[n_blocks - n_keys :]
    with np.errstate(over="ignore"):
        return mixed(sketch[chosen] ^ mixed(chosen.astype(U) + U((band + 1) << 40)))


def parity_sketch(set_: np.ndarray, each: int = 4) -> np.ndarray:
    """Words of the whole set's parity sketch: a power of two of bits, at least ``each`` for each element."""
    bits = 1 << max(6, (each * max(1, len(set_)) - 1).bit_length())
    at = set_ & U(bits - 1)
    out = np.zeros(bits // 64, U)
    np.bitwise_xor.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch with fewer bits: element h's bit h mod 2m falls on h mod m."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


@cache
def scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def packed(keys: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """A bucket's list by document: the keys' lower 48 bits, the ids' differences deflated."""
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    low = keys.astype(np.uint32).tobytes() + (keys >> U(32)).astype(np.uint16).tobytes()
    return low, zlib.compress(np.diff(docs, prepend=0).astype("<i8").tobytes(), 1)


def unpacked(low: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(low) // 6
    keys = np.frombuffer(low, np.uint32, n).astype(U) | np.frombuffer(low, np.uint16, n, 4 * n).astype(U) << U(32)
    return keys, np.cumsum(np.frombuffer(zlib.decompress(docs), "<i8"))


SCAN = "kind int, doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch binary, small binary, key bigint, hub bigint, node bigint, bucket int, keys binary, docs binary"
_SCAN_TYPES = [pa.int32()] + [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.binary()]
_SCAN_NAMES = [x.split()[0] for x in SCAN.split(", ")]


#: The kinds of rows, by the first column that they have.
KINDS = ["doc_id", "key", "bucket"]


def _rows(**columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = [KINDS.index(next(iter(columns)))] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(_SCAN_NAMES, _SCAN_TYPES, strict=True)], _SCAN_NAMES)


def _groups(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, doc) rows: each key once with its first doc as centre; and the rows of keys with several, with centres."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    new = first | np.concatenate([[True], docs[1:] != docs[:-1]])
    keys, docs, first = keys[new], docs[new], first[new]
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(keys)))
    many = np.repeat(count > 1, count)
    hub = np.repeat(docs[start], count)
    return start, keys, docs, np.stack([many.astype(np.int64), hub])


def scan(docs: DataFrame, width: int, num: int, den: int, n_buckets: int) -> DataFrame:
    """One pass over the texts.  Three kinds of rows: of documents (doc_id, n, h1, h2, sketch); members of blocks that
    several sets of a task share (key, hub, node); and packed (block key, centre) lists for the buckets of the join."""
    shift = 64 - (n_buckets - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = scheme(num, den)
        keys: list[np.ndarray] = []
        owners: list[int] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if size:
                flat = np.concatenate(keys)
                start, k, d, (many, hub) = _groups(flat, np.repeat(np.array(owners, np.int64), [len(x) for x in keys]))
                at = np.flatnonzero(many)
                for i in range(0, len(at), 50_000):
                    own = at[i : i + 50_000]
                    short = k[own] & U((1 << 48) - 1) | k[own] >> U(shift) << U(shift)  # as the buckets have it
                    yield _rows(key=short.view(np.int64), hub=hub[own], node=d[own])
                k, d = k[start], d[start]  # sorted by key, so by bucket
                bounds = np.searchsorted(k >> U(shift), np.arange(n_buckets + 1, dtype=U))
                own = [(b, i, j) for b, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if i < j]
                lists = [packed(k[i:j], d[i:j]) for _, i, j in own]
                yield _rows(bucket=[b for b, _, _ in own], keys=[x for x, _ in lists], docs=[x for _, x in lists])
            keys.clear()
            owners.clear()
            seen.clear()
            size = 0

        for b in batches:
            info = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), width)
                d = xxhash.xxh3_128(s.tobytes()).digest()
                same = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
                sketch = parity_sketch(s)
                small = folded(sketch, max(1, len(sketch) // 4))
                info.append((doc_id, len(s), *same, sketch.tobytes() if len(s) else None, small.tobytes() if len(s) else None))
                if doc_id is None or not len(s) or same in seen:
                    continue
                own = plan.keys(s)
                if len(own):
                    seen.add(same)
                    keys.append(own)
                    owners.append(doc_id)
                    size += len(own)
                    if size >= FLUSH_KEYS:
                        yield from flush()
            if info:
                yield _rows(**dict(zip(_SCAN_NAMES[1:7], map(list, zip(*info, strict=True)), strict=True)))
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN)


def shared_blocks(lists: DataFrame, n_buckets: int) -> DataFrame:
    """(key, hub, node) of the block keys that several tasks have; each bucket is joined by sorting packed arrays."""
    shift = 64 - (n_buckets - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for bucket, k, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found.setdefault(bucket, []).append((k, d))
        for bucket, parts in found.items():
            k, d = (np.concatenate(x) for x in zip(*(unpacked(*x) for x in parts), strict=True))
            parts.clear()
            _, k, d, (many, hub) = _groups(k, d)
            at = np.flatnonzero(many)
            for i in range(0, len(at), 50_000):
                own = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array((k[own] | U(bucket) << U(shift)).view(np.int64)), pa.array(hub[own]), pa.array(d[own])], ["key", "hub", "node"])

    return lists.repartition(n_buckets, "bucket").mapInArrow(run, "key bigint, hub bigint, node bigint")


def sketch_passes(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda x: facts.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    plan = (num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scheme(*plan)
        for b in batches:
            keep = []
            for n_a, s_a, n_b, s_b in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                least, most = min(n_a, n_b), max(n_a, n_b)
                keep.append(most * num <= least * den and hamming(np.frombuffer(s_a, U), np.frombuffer(s_b, U)) <= s.differ(least))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, saved: Saved) -> DataFrame:
    """The pairs (a, b) that link.  Only the candidates' texts are read again; their sets are saved once."""
    ids = saved.keep(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in part.column(1)], pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    sets = saved.keep(texts.mapInArrow(run, "id bigint, set binary"), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x, U), np.frombuffer(y, U), num, den) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = saved.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(test, "a bigint, b bigint"), "links")
    saved.drop(ids, sets)
    return out


def bounded(df: DataFrame) -> DataFrame:
    """A saved table of ids, broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def across(members: DataFrame, facts: DataFrame, num: int, den: int, forest: bool, sketch: str, saved: Saved) -> DataFrame:
    """Pairs (key, a, b, more) in a block of ``members`` (key, node, component) across components whose sizes and
    sketches (of the named column) allow a link: all, or a spanning forest of the components from the nearest pairs;
    ``more`` says that a block has pairs beyond it.  Of blocks with the same sets one is compared."""
    h = [F.xxhash64("node"), F.xxhash64(F.lit(1), "node")]
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(h[0]).alias("x"), F.bit_xor(h[1]).alias("y"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    sizes = saved.keep(sizes.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "open")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    rows = members.join(bounded(sizes), "key").withColumn("chunk", own)
    other = F.when(chunks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))
    rows = rows.withColumn("other", F.explode(other))
    rows = rows.select("key", "node", "component", "chunk", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"))
    rows = rows.join(facts.select(F.col("doc_id").alias("node"), "n", F.col(sketch).alias("sketch")), "node")
    rows = rows.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_rows = 0
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                held.append(b.slice(at, CHUNK))
                n_rows += held[-1].num_rows
                if n_rows >= 4 * CHUNK:
                    whole = pa.Table.from_batches(held)
                    group = _group_numbers(whole)
                    ready = int(np.searchsorted(group, group[-1]))  # the last group may go on
                    if ready:
                        yield from compare(whole.slice(0, ready), group[:ready])
                    held, n_rows = whole.slice(ready).to_batches(), n_rows - ready
        if n_rows:
            whole = pa.Table.from_batches(held)
            yield from compare(whole, _group_numbers(whole))

    def compare(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, n, node, comp, chunk, c1, c2 = (rows[c].to_numpy() for c in ("key", "n", "node", "component", "chunk", "c1", "c2"))
        i, j, far = passing_pairs(group, n, comp, chunk, c1 == c2, rows["sketch"].to_pylist(), scheme(num, den))
        order = np.lexsort((far / n[i], group[i]))
        keep, more = [], set()
        parent: dict[tuple[int, int], tuple[int, int]] = {}

        def root(x: tuple[int, int]) -> tuple[int, int]:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for k in order.tolist():
            g = int(group[i[k]])
            if forest:
                x, y = root((g, int(comp[i[k]]))), root((g, int(comp[j[k]])))
                if x == y:
                    more.add(g)
                    continue
                parent[max(x, y)] = min(x, y)
            keep.append(k)
        if not forest:  # one row for a pair, whatever blocks it shares
            keep = np.unique(np.stack([node[i], node[j]], axis=1), axis=0, return_index=True)[1] if len(i) else keep
        i, j = i[keep], j[keep]
        beyond = np.isin(group[i], np.array(sorted(more), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(beyond)], ["key", "a", "b", "more"])

    return rows.mapInArrow(run, "key bigint, a bigint, b bigint, more boolean")


def _group_numbers(rows: pa.Table) -> np.ndarray:
    """Numbers of the runs of equal (key, c1, c2)."""
    change = np.zeros(rows.num_rows, bool)
    for c in ("key", "c1", "c2"):
        x = rows[c].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def passing_pairs(group: np.ndarray, n: np.ndarray, comp: np.ndarray, chunk: np.ndarray, within: np.ndarray, sketches: list[bytes], plan: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (i, j) of a group, across components (and, if not ``within``, across chunks), that may link by size and
    sketch, and the sketches' distances.  Rows lie by group and then n; row i meets the rows at distance 1, 2, ... as long as their sizes allow."""
    words = np.array([len(x) // 8 for x in sketches])
    allowed = plan.differ(n)
    last = np.searchsorted(group, group, side="right")
    out_i, out_j, out_far = [], [], []
    for w in np.unique(words):
        own, double = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        place = np.full(len(n), -1)
        place[own], place[double] = np.arange(len(own)), np.arange(len(own), len(own) + len(double))
        flat = np.frombuffer(b"".join([sketches[k] for k in own]), U).reshape(-1, w)
        if len(double):
            wide = np.frombuffer(b"".join([sketches[k] for k in double]), U).reshape(-1, 2, w)
            flat = np.concatenate([flat, wide[:, 0] ^ wide[:, 1]])
        active, step = own, 1
        while len(active):
            active = active[active + step < last[active]]
            active = active[n[active + step] * plan.num <= n[active] * plan.den]
            j = active + step
            test = (comp[active] != comp[j]) & (within[active] | (chunk[active] != chunk[j]))
            i, j = active[test], j[test]
            if len(i):
                far = np.bitwise_count(flat[place[i]] ^ flat[place[j]]).sum(axis=1, dtype=np.int64)
                near = far <= allowed[i]
                out_i.append(i[near])
                out_j.append(j[near])
                out_far.append(far[near])
            step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), np.concatenate([none, *out_far])


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    A set holds the distinct ``width``-word shingles of the lower-cased (A-Z) text, or all its words as one if they
    are fewer.  Two documents link when den * intersection >= num * union; component_id is the smallest doc_id that
    links reach; ids that are no whole numbers are refused.  A null or empty text has an empty set and links with nothing, equal empty texts neither.  Rows
    repeated with one doc_id are one document; a row without an id has no component and links with nothing.  An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    saved = Saved(spark, "jaccard")
    docs = integral_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / 6 * 2 * (den - num) / num
    n_buckets = 1 << max(MIN_BUCKETS.bit_length() - 1, int(expected / BUCKET_KEYS).bit_length())
    scanned = saved.keep(scan(docs, width, num, den, n_buckets), "scan", ["kind"])
    kinds = [spark.read.parquet(f"{scanned._saved_path}/kind={i}") if scanned.where(F.col("kind") == i).limit(1).count() else scanned.where("false") for i in range(len(KINDS))]
    info = kinds[0].select("doc_id", "n", "h1", "h2")

    classes = info.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    classes = saved.keep(classes, "classes")
    is_hot = F.col("size") > max(1, info.count() * HOT)
    full, hot = info.where("n > 0"), F.broadcast(classes.where(is_hot))  # at most 1 / HOT classes are hot
    of_hot = full.join(hot, ["h1", "h2"])
    of_rest = full.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(classes.where(~is_hot), ["h1", "h2"])
    copies = of_hot.unionByName(of_rest).where("doc_id != rep").select("doc_id", "rep").distinct()
    copies = saved.keep(copies, "copies")
    rep_of = bounded(copies)

    blocks = kinds[1].select("key", "hub", "node")
    blocks = blocks.unionByName(shared_blocks(kinds[2].select("bucket", "keys", "docs"), n_buckets))
    to_rep = lambda df, c: df.join(rep_of.select(F.col("doc_id").alias(c), F.col("rep").alias(f"rep_{c}")), c, "left").withColumn(c, F.coalesce(f"rep_{c}", c)).drop(f"rep_{c}")
    blocks = saved.keep(to_rep(to_rep(blocks, "hub"), "node"), "blocks")
    for i in (1, 2):
        saved.drop_path(f"{scanned._saved_path}/kind={i}")
    members = saved.keep(blocks.select("key", "node").distinct(), "members")
    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    facts = kinds[0].where("n > 0").join(bounded(saved.keep(nodes, "nodes")), "doc_id", "left_semi")
    facts = saved.keep(facts.groupBy("doc_id", "n").agg(F.first("sketch").alias("sketch"), F.first("small").alias("small")), "facts")

    # each set meets the centre with which it shares most blocks
    near = blocks.where("hub != node").groupBy("node", "hub").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    stars = near.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    tested = saved.keep(stars, "stars")
    saved.drop(blocks)
    passed = saved.keep(sketch_passes(tested, facts, num, den), "pairs")
    links = verified(passed, docs, width, num, den, saved)
    comp = saved.keep(components(links, saved), "components")
    for forest, sketch in ((True, "small"), (True, "sketch"), (False, "sketch")):
        now = members.join(bounded(comp), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        found = saved.keep(across(now, facts, num, den, forest, sketch, saved), "across")
        open_ = saved.keep(found.where("more").select("key").distinct(), "beyond")
        more = saved.keep(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if more.limit(1).count():
            tested = tested.unionByName(more)
            passed = saved.keep(sketch_passes(more, facts, num, den), "pairs")
            links = links.unionByName(verified(passed, docs, width, num, den, saved))
            comp = saved.keep(components(links, saved), "components")
        if not open_.limit(1).count():
            break
        members = saved.keep(members.join(bounded(open_), "key", "left_semi"), "members")

    rep_comp = comp.where("node != component").select(F.col("node").alias("rep"), "component")
    of_copy = copies.join(rep_comp, "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component_id"))
    of_rep = rep_comp.select(F.col("rep").alias("id"), F.col("component").alias("component_id"))
    moved = of_copy.unionByName(of_rep).groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = info.join(moved, (F.col("doc_id") == F.col("id")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
