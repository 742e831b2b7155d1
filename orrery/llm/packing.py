"""Packing: order-preserving dynamic programming over window cuts.

The token stream of a scan task, documents in order, is cut into windows (sequences) of at most ``size`` tokens.
Cuts may fall at document ends (free), at sentence ends (a small truncation penalty) or, where neither comes for
long, inside a sentence (a larger one).  A window of L tokens costs its padding, ``size - L`` or nothing if L is a
power of two, plus ``PER_WINDOW``, plus the penalty of its right cut.  With p the position of a cut,

    best(j) = penalty(j) + min over i of best(i) + pad(p[j] - p[i]) + PER_WINDOW

and since pad(L) = size - L is linear, the inner minimum is that of ``best(i) + p[i]`` over a sliding window: a
monotone queue gives it in amortised constant time.  The lengths that need no padding are looked up one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table
from orrery.llm.tokens import Encoder

SIZE = 2048
EOS = 1
#: Costs in tokens of padding: of a cut at a sentence end, of one inside a sentence, and of each window.
SENTENCE, INSIDE, PER_WINDOW = 6.0, 24.0, 16.0
#: Where cuts are further apart than this, further ones are offered at this distance.
GAP = 256
#: Tokens of a block that is solved at once; its last window is carried into the next block.
BLOCK = 1 << 19

SCHEMA = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into ``at`` (ascending positions, at[0] = 0, no gap over ``size``) of the cuts of least total cost."""
    pos, pen = at.tolist(), penalty.tolist()
    n = len(pos)
    index = {p: i for i, p in enumerate(pos)}
    exact = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()  # indices i with best[i] + pos[i] ascending
    for j in range(1, n):
        i = j - 1
        key = best[i] + pos[i]
        while queue and best[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        least, source = best[i] + pos[i] - p + size, i
        for length in exact:
            i = index.get(p - length)
            if i is not None and best[i] < least:
                least, source = best[i], i
        best[j] = least + pen[j] + PER_WINDOW
        back[j] = source
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def offered(length: int, ends: np.ndarray, sentences: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a block of ``length`` tokens may be cut, with their penalties: document ends, sentence ends, and others in long gaps."""
    pen = np.full(length + 1, np.inf)
    pen[sentences[sentences <= length]] = SENTENCE
    pen[ends[ends <= length]] = 0.0
    pen[0] = pen[length] = 0.0
    at = np.flatnonzero(np.isfinite(pen))
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        more = np.concatenate([np.arange(at[i] + gap, at[i + 1], gap) for i in wide])
        pen[more] = INSIDE
        at = np.flatnonzero(np.isfinite(pen))
    return at, pen[at]


def sentence_tokens(encoder: Encoder) -> np.ndarray:
    """For each id of the vocabulary: does a sentence or line end with it?"""
    words = encoder.token_strings()
    ending = re.compile("[.!?…]['\"”»)]*\\s*$|\n\\s*$")
    out = np.zeros(max(words) + 2, bool)
    for i, word in words.items():
        out[i] = bool(ending.search(word))
    return out


_ENDINGS: dict[str, np.ndarray] = {}


class Packer:
    """Packs a stream of (doc_id, ids) into windows; gives rows as soon as a block is solved."""

    def __init__(self, sequence0: int, ending: np.ndarray, size: int = SIZE, block: int = BLOCK) -> None:
        self.sequence, self.ending, self.size, self.block = sequence0, ending, size, block
        self.parts: list[list] = []  # [doc_id, ids, start in the document, tokens of the document, whether it ends here]
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at, total = 0, len(ids)
        while at < total:  # a document longer than a block is given to several
            take = min(total - at, self.block)
            self.parts.append([doc_id, ids[at : at + take], at, total, at + take == total])
            at += take
            self.held += take
            if self.held >= self.block:
                yield from self.solve(last=False)

    def solve(self, last: bool) -> Iterator[tuple]:
        if not self.parts:
            return
        flat = np.concatenate([p[1] for p in self.parts])
        bounds = np.cumsum([0] + [len(p[1]) for p in self.parts])
        ends = bounds[1:][[p[4] for p in self.parts]]
        at, pen = offered(len(flat), ends, np.flatnonzero(self.ending[flat]) + 1)
        cuts = at[best_cuts(at, pen, self.size)].tolist()
        if not last and len(cuts) > 2:
            cuts.pop()  # the last window may still grow
        k = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            while bounds[k + 1] <= a:
                k += 1
            j = k
            while j < len(self.parts) and bounds[j] < b:
                lo, hi = max(a, bounds[j]), min(b, bounds[j + 1])
                doc_id, _, start, total, _ = self.parts[j]
                yield doc_id, int(start + lo - bounds[j]), int(hi - lo), zlib.crc32(flat[lo:hi].astype("<u4").tobytes()), total, self.sequence, int(lo - a)
                j += 1
            self.sequence += 1
        done = cuts[-1]
        rest = []
        for j, (doc_id, ids, start, total, end) in enumerate(self.parts):
            if bounds[j + 1] > done:
                skip = max(0, done - int(bounds[j]))
                rest.append([doc_id, ids[skip:], start + skip, total, end])
        self.parts, self.held = rest, len(flat) - done


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep the order in which the scan gives them; each is its ids and then the id 1, so a null or empty
    text is that one id.  Repeated rows are packed again, a null doc_id stays null, an empty table gives no rows,
    other columns are not read.  Every scan task packs what it reads, in blocks of ``BLOCK`` tokens, without a
    shuffle; its sequences are numbered from its task number times 2^32, so that a task run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        if tokenizer_path not in _ENDINGS:
            _ENDINGS[tokenizer_path] = sentence_tokens(encoder)
        packer = Packer(TaskContext.get().partitionId() << 32, _ENDINGS[tokenizer_path], size)
        rows: list[tuple] = []
        kind = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(EOS)).astype(np.uint32)
                rows.extend(packer.add(doc_id, ids))
                if len(rows) >= 20_000:
                    yield out()
        rows.extend(packer.solve(last=True))
        if rows:
            yield out()

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, SCHEMA.format(kind=read.schema["doc_id"].dataType.simpleString()))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
