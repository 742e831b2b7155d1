"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries into pieces of bounded size, pieces are gathered into batches of about
equal bytes, and a batch is encoded at once.  Every worker loads a vocabulary once.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table

#: Bytes of text encoded at once, and the most that one piece of a long text may have if a safe boundary allows.
BATCH_BYTES = 1 << 18
PIECE_CHARS = 1 << 16
#: A blank between two letters always starts a pre-token of the byte-level pattern and never lies inside a special token.
SAFE_BLANK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters about which the two libraries' pattern engines agree whatever Unicode version each was built with.
#: Any other character sends its text to the vocabulary's own library.
SETTLED = re.compile("[^\x00-ɏΑ-ΡΣ-ϿЀ-џ‐-‧‰-⁞一-龥ぁ-ゖァ-ヺ가-힣]")

_ENCODERS: dict[str, Encoder] = {}


def pieces(text: str, limit: int = PIECE_CHARS, boundary: re.Pattern | None = SAFE_BLANK) -> Iterator[str]:
    """``text`` in order, in pieces of about ``limit`` characters, cut only where no token can span the cut.

    A stretch without a safe boundary stays in one piece, however long.
    """
    at = 0
    while boundary is not None and len(text) - at > limit:
        cut = boundary.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    """One vocabulary.  A ``.json`` file is encoded by ``tokenizers``, a ``.model`` file by ``sentencepiece``.

    If the byte-level ``.json`` vocabulary lies beside the same vocabulary as ranks (``.tiktoken``), texts of settled
    characters and without special strings go through the rank encoder: same pattern, same merges, same ids, a
    quarter of the time.  ``tests/llm`` compares both over every settled character.
    """

    def __init__(self, path: str) -> None:
        self.fast = None
        self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.boundary = None  # its normaliser works on whole texts
            return
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.path = path
        self.specials = [t["content"] for t in told.get("added_tokens") or []]
        byte_level = (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not told.get("normalizer")
        self.boundary = SAFE_BLANK if byte_level else None
        ranks = path[: -len(".json")] + ".tiktoken"
        if byte_level and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                self.known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.known, special_tokens={})

    @cached_property
    def slow(self):
        """The vocabulary's own library, loaded when a text needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def token_strings(self) -> dict[int, str]:
        """The text of each id, as far as it is text of its own."""
        if self.fast is not None:
            return {i: t.decode("utf-8", "replace") for t, i in self.known.items()}
        return {i: t.replace("Ċ", "\n").replace("Ġ", " ") for t, i in self.slow.get_vocab().items()}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def settled(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or not SETTLED.search(text)) and not any(s in text for s in self.specials)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text, without begin, end or added special tokens."""
        if not text:
            return np.empty(0, np.uint32)
        out = []
        if self.model is not None:
            return np.asarray(self.model.encode(text), np.uint32)
        settled = self.settled(text)
        for piece in pieces(text, boundary=self.boundary):
            got = self.fast.encode_ordinary(piece) if settled else self.slow.encode(piece, add_special_tokens=False).ids
            out.append(np.array(got, np.uint32))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Tokens of each piece of a batch."""
        if self.model is not None:
            return np.fromiter(map(len, self.model.encode(texts, num_threads=1)), np.int64, len(texts))
        n = np.zeros(len(texts), np.int64)
        rest = []
        for i, t in enumerate(texts):
            if self.settled(t):
                n[i] = len(self.fast.encode_ordinary(t))
            else:
                rest.append(i)
        if rest:
            got = self.slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
            n[rest] = [len(e) for e in got]
        return n

    def count(self, texts: Iterable[str | None], batch_bytes: int = BATCH_BYTES) -> np.ndarray:
        """Tokens of each text; None counts as empty."""
        owners: list[int] = []
        batch: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if batch:
                np.add.at(out, owners, self.lengths(batch))
            owners.clear()
            batch.clear()
            size = 0

        texts = list(texts)
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for piece in pieces(text or "", boundary=self.boundary):
                if piece:
                    owners.append(i)
                    batch.append(piece)
                    size += len(piece)
                    if size >= batch_bytes:
                        flush()
        flush()
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty (0, 0, false); a null id stays null; repeated rows each give a row; an empty table
    gives none; other columns of ``docs`` are not read.  No shuffle: each scan task encodes what it reads.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        for b in batches:
            n = encoder.count(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    out = read.mapInArrow(encode, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
