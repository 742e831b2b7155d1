"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

Every document's words stream through the automaton, which keeps the longest match that ends at each word.  Where
it reaches ``window`` words (or the whole of a shorter item), those words are hit.  An automaton holds about
``CHUNK_BYTES`` of items, whose size is checked before it is built and broadcast.  A larger benchmark is dealt over
several automata that take turns; then a Bloom filter of the item windows first sets aside the documents that need them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from orrery.llm.common import Saved, nested, table, unnested

WINDOW = 10
CHUNK_BYTES = 1 << 20
#: Lower-cases A-Z and makes a blank of what is no word; bytes of characters beyond ASCII are word bytes.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; ``scan`` gives hit intervals and the items whose windows occur."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(k, w) for k, w in items if w]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: By state: items with a window that ends there; and (words, items) of whole items under ``window`` words.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for key, words in items:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= window:
                    self.items.setdefault(self._at_window(state), set()).add(key)
            if len(words) < window:
                self.short.setdefault(self._at(state, len(words)), {}).setdefault(len(words), set()).add(key)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.has_short = [False] * len(self.length)
        for s in order[1:]:
            self.has_short[s] = s in self.short or self.has_short[self.link[s]]

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, dict(nxt[q]), link[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _at(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _at_window(self, state: int) -> int:
        return self._at(state, self.window)

    def scan(self, words: list[bytes], intervals: list[list[int]], found: set[str]) -> None:
        """Add [first, last] word intervals, merged and in order, and the items whose windows occur."""
        nxt, link, length, has_short, window = self.next, self.link, self.length, self.has_short, self.window
        state = matched = 0
        for p, w in enumerate(words):
            following = nxt[state].get(w)
            if following is None:
                while state:
                    state = link[state]
                    following = nxt[state].get(w)
                    if following is not None:
                        break
                if following is None:
                    matched = 0
                    continue
                matched = length[state]
            state = following
            matched += 1
            if matched >= window:
                self._hit(intervals, p - window + 1, p)
                found |= self.items[self._at_window(state)]
            if has_short[state]:
                s = state
                while s > 0:
                    for n, keys in self.short.get(s, {}).items():
                        if n <= matched:
                            self._hit(intervals, p - n + 1, p)
                            found |= keys
                    s = link[s]

    @staticmethod
    def _hit(intervals: list[list[int]], first: int, last: int) -> None:
        while intervals and intervals[-1][1] >= first - 1 and intervals[-1][0] <= last + 1:
            a, b = intervals.pop()
            first, last = min(a, first), max(b, last)
        intervals.append([first, last])


def merged(intervals: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def item_pieces(benchmark: DataFrame, window: int, chunk_bytes: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(k, t) of the items; a long one comes in pieces that overlap by ``window`` - 1 words, so each window is whole in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, out = words_of(text.as_py()), []
                start = 0
                while start == 0 or start + window - 1 < len(words):
                    size, end = 0, start
                    while end < len(words) and (size < chunk_bytes // 8 or end - start < 2 * window):
                        size += len(words[end]) + 1
                        end += 1
                    out.append(b" ".join(words[start:end]).decode())
                    if end >= len(words):
                        break
                    start = end - window + 1
                yield pa.RecordBatch.from_arrays([pa.array([key or ""] * len(out), pa.string()), pa.array(out, pa.string())], ["k", "t"])

    items = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    return items.mapInArrow(cut, "k string, t string").where("t != ''")


def item_chunks(pieces: DataFrame, saved: Saved, chunk_bytes: int = CHUNK_BYTES) -> list[DataFrame]:
    """The pieces dealt by hash over chunks of about ``chunk_bytes``, each a folder of its own."""
    size = pieces.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    if n == 1:
        return [pieces]
    dealt = saved.keep(pieces.withColumn("chunk", F.pmod(F.xxhash64("k", "t"), F.lit(n)).cast("int")), "chunks", ["chunk"])
    return [dealt.where(F.col("chunk") == i).select("k", "t") for i in range(n)]  # reads the folder of that chunk only


def collected(chunk: DataFrame) -> list[tuple[str, list[bytes]]]:
    """A chunk's items on the driver: about ``CHUNK_BYTES``."""
    return [(r["k"], r["t"].encode().split()) for r in chunk.collect()]


class WindowFilter:
    """Bloom filter of item windows, at most ``MAX_BITS``: more windows let more documents pass, and never lose one."""

    MAX_BITS = 1 << 28

    def __init__(self, n_bytes: int, window: int) -> None:
        self.window, self.sizes = window, set()
        self.bits = np.zeros(min(self.MAX_BITS, 1 << max(16, (3 * n_bytes).bit_length())) >> 3, np.uint8)

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def windows(self, h: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words."""
        out = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for j in range(size):
            out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _places(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for shift in (0, 20, 36):
            at = (w >> np.uint64(shift)) % np.uint64(len(self.bits) * 8)
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, words: list[bytes]) -> None:
        size = min(self.window, len(words))
        self.sizes.add(size)
        for byte, bit in self._places(self.windows(self.hashes(words), size)):
            np.bitwise_or.at(self.bits, byte, bit)

    def may_hit(self, words: list[bytes]) -> bool:
        h = self.hashes(words)
        for size in self.sizes:
            if len(h) >= size:
                hit = np.ones(len(h) - size + 1, bool)
                for byte, bit in self._places(self.windows(h, size)):
                    hit &= (self.bits[byte] & bit) > 0
                if hit.any():
                    return True
        return False


Finish = Callable[[pa.RecordBatch, list, list], pa.RecordBatch]


def _slices(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, max(1, whole.num_rows), 1024):
            yield of(whole.slice(at, 1024))


def through(docs: DataFrame, benchmark: DataFrame, columns: list, finish: Finish, schema: str | StructType, window: int, chunk_bytes: int) -> DataFrame:
    """``columns`` of ``docs`` (text last) through the automata of the benchmark's chunks.

    ``finish(batch, spans, items)`` makes the result of a batch, from merged [first, last] word numbers and item ids.
    One chunk is one scan.  With more, a first scan sets aside the documents that a Bloom filter of the item windows
    lets pass; these go through one automaton after the other, each broadcast, used and destroyed in its own round, so
    one automaton at a time is held, and documents without any window are read once.
    """
    spark = docs.sparkSession
    saved = Saved(spark, "decontamination")
    out = docs.select(*columns)
    n = len(out.columns)
    chunks = item_chunks(item_pieces(benchmark, window, chunk_bytes), saved, chunk_bytes)

    def scan(batches: Iterator[pa.RecordBatch], sent, last: bool) -> Iterator[pa.RecordBatch]:
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            old_spans, old_items = ([[]] * b.num_rows, [[]] * b.num_rows) if last else (b.column(n).to_pylist(), b.column(n + 1).to_pylist())
            spans, items = [], []
            for text, s, k in zip(b.column(n - 1), old_spans, old_items, strict=True):
                found: set[str] = set(k)
                intervals: list[list[int]] = []
                sent.value.scan(words_of(text.as_py()), intervals, found)
                spans.append(merged(s + intervals))
                items.append(sorted(found))
            if last:
                return finish(b, spans, items)
            return pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], b.schema.names)

        return _slices(batches, of)

    if len(chunks) == 1:
        only = spark.sparkContext.broadcast(Automaton(collected(chunks[0]), window))
        return out.mapInArrow(partial(scan, sent=only, last=True), schema)

    windows = WindowFilter(len(chunks) * chunk_bytes, window)
    for chunk in chunks:
        for _, words in collected(chunk):
            windows.add(words)
    sent_windows = spark.sparkContext.broadcast(windows)
    state = StructType([StructField("spans", ArrayType(ArrayType(IntegerType()))), StructField("items", ArrayType(StringType()))])
    boxed = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns[:-1]] or [F.lit(0).alias("none")]).alias("columns"), F.col(f"`{out.columns[-1]}`").alias("text"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            maybe = [sent_windows.value.may_hit(words_of(t.as_py())) for t in b.column(1)]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe, pa.bool_())], ["columns", "text", "maybe"])

        return _slices(batches, of)

    sifted = saved.keep(boxed.mapInArrow(sift, StructType([*boxed.schema.fields, StructField("maybe", BooleanType())])), "sifted", ["maybe"])
    opened = [*[F.col("columns")[c].alias(c) for c in out.columns[:-1]], F.col("text").alias(out.columns[-1])]
    rest, now = sifted.where("NOT maybe").select(*opened), sifted.where("maybe").select(*opened)
    names = [f"c{i}" for i in range(n)]
    between = StructType([StructField(c, f.dataType) for c, f in zip(names, out.schema.fields, strict=True)] + state.fields)
    now = now.toDF(*names).select("*", F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for chunk in chunks:
        sent = spark.sparkContext.broadcast(Automaton(collected(chunk), window))
        before, now = now, saved.keep(now.mapInArrow(partial(scan, sent=sent, last=False), between), "round")
        sent.destroy()
        if hasattr(before, "_saved_path"):
            saved.drop(before)

    def end(batches: Iterator[pa.RecordBatch], clean: bool) -> Iterator[pa.RecordBatch]:
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            own = pa.RecordBatch.from_arrays(b.columns[:n], out_names)
            return finish(own, [[]] * b.num_rows, [[]] * b.num_rows) if clean else finish(own, b.column(n).to_pylist(), b.column(n + 1).to_pylist())

        return _slices(batches, of)

    out_names = out.columns
    hit = now.mapInArrow(partial(end, clean=False), schema)
    return rest.mapInArrow(partial(end, clean=True), schema).unionByName(hit)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words; a null item has no window; a null item_id counts as the id ''.  Repeated rows
    each give a row, repeated items count once by id, an empty benchmark hits nothing; other columns are not read.
    """

    def digest(b: pa.RecordBatch, spans: list, items: list) -> pa.RecordBatch:
        n_words = [len(words_of(t.as_py())) for t in b.column(1)]
        n_hit = [sum(z - a + 1 for a, z in s) for s in spans]
        hashes = [hashlib.sha256(",".join(k).encode()).hexdigest() for k in items]
        columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(k) for k in items], pa.int64()), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"
    return through(docs, benchmark, ["doc_id", "text"], digest, schema, window, chunk_bytes).withColumn("contaminated", F.col("n_hit") > 0)


def remove_words(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them; what is left is joined by one blank."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    parts, start = [], 0
    for first, last in spans:
        parts.append(raw[start : at[first][0]])
        start = at[last][1]
    parts.append(raw[start:])
    return b" ".join(x for x in (p.strip() for p in parts) if x).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``documents`` without benchmark passages: hit spans are cut out; documents of which they cover more than
    ``max_coverage`` of the words go.  Other rows, null and empty texts among them, stay as they are; n_chars follows
    the text.  Rows are judged one by one, so null and repeated ids change nothing; no column's name can clash."""

    def clean(b: pa.RecordBatch, spans: list, _: list) -> pa.RecordBatch:
        keep, texts = [], []
        for text, s in zip(b.column(1), spans, strict=True):
            text = text.as_py()
            keep.append(not s or sum(z - a + 1 for a, z in s) <= max_coverage * len(words_of(text)))
            texts.append(remove_words(text, s) if keep[-1] else None)
        changed = pa.array([bool(s) for s in spans], pa.bool_())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), changed], ["row", "text", "changed"]).filter(pa.array(keep, pa.bool_()))

    read = docs.select(nested(docs), "text")
    schema = StructType([read.schema["row"], StructField("text", StringType()), StructField("changed", BooleanType())])
    found = through(docs, benchmark, [nested(docs), "text"], clean, schema, window, CHUNK_BYTES)
    lengths = {c: F.when(F.col("changed"), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]) for c in docs.columns if c == "n_chars"}
    return found.select(*unnested(docs.columns, F.col("text"), **lengths))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
