"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

A word is a run of letters and marks; its script is that of its characters' code-point range.  Only the languages that
write in a word's script are its candidates and are scored.  A candidate's score is the log-likelihood of the word's
character trigrams (with the blanks around it), learned from labelled documents.  Viterbi with a constant cost for
changing language labels the words, so mixed texts come out as spans; a document's language is that of most of its
words, its score their share of all its words.  Words in a script that no learned language writes take their
neighbours' language in spans, but have no say in the document's language and no part in its score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from orrery.llm.common import table

#: The classifier is fitted on about so many labelled documents of a language at most, chosen by a hash of the id.
DOCS_PER_LANGUAGE = 2500
#: Hashed trigrams at most, and cells (trigrams x languages) at most, so that the model that is broadcast has at most 64 MB
#: for languages of one script each: beyond 256 languages they share fewer trigrams.
FEATURES, MIN_FEATURES, MODEL_CELLS = 1 << 16, 1 << 10, 1 << 24
SWITCH = 12.0
#: Paths whose scores differ by less are told apart by Viterbi alone.
NEAR = 0.1
#: The score of a word in a language that is no candidate: no path goes there.
NO_CANDIDATE = -1e4
#: A language writes in a script that so many of its words are in.
WRITES = 0.01
#: Long texts are labelled in stretches of so many words, so that the back pointers held at once are bounded; scores carry over.
STRETCH = 4096
#: Texts are scored together up to so many characters, fewer if there are more than so many languages.
SCORE_CHARS, SCORE_LANGUAGES = 1 << 20, 200

#: Script ranges by code point; of a word in several scripts the later one in the list counts.
SCRIPT_RANGES = [
    ("Latin", [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Syriac", [(0x700, 0x74F)]),
    ("Thaana", [(0x780, 0x7BF)]),
    ("Devanagari", [(0x900, 0x97F), (0xA8E0, 0xA8FF)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Oriya", [(0xB00, 0xB7F)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("Ethiopic", [(0x1200, 0x139F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Mongolian", [(0x1800, 0x18AF)]),
    ("Han", [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
]
SCRIPTS = {name: i for i, (name, _) in enumerate(SCRIPT_RANGES, 1)}
OTHER_SCRIPT = len(SCRIPT_RANGES) + 1
N_SCRIPTS = len(SCRIPT_RANGES) + 2
_LAST = 0x3FFFF  # further code points count as this one: no letters are assigned beyond


@cache
def script_table() -> np.ndarray:
    """The script of each code point; 0 if it is neither letter nor mark and so separates words."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(_LAST + 1)), bool, _LAST + 1)
    out = np.full(_LAST + 1, OTHER_SCRIPT, np.uint8)
    for name, ranges in SCRIPT_RANGES:
        for first, last in ranges:
            out[first : last + 1] = SCRIPTS[name]
    out[~letter] = 0
    return out


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with blanks for what is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(script_table()[np.minimum(raw, _LAST)] > 0, raw, np.uint32(32))


def feature_count(n_languages: int) -> int:
    return max(MIN_FEATURES, min(FEATURES, 1 << (MODEL_CELLS // max(1, n_languages)).bit_length() - 1))


def features(raw: np.ndarray, size: int) -> np.ndarray:
    """The feature of each character: a hash of it and its neighbours; ``size`` is a power of two."""
    wide = np.empty(len(raw) + 2, np.uint32)
    wide[0] = wide[-1] = 32
    wide[1:-1] = raw
    gram = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA6B)) ^ (wide[2:] * np.uint32(0xC2B2AE35))
    gram ^= gram >> np.uint32(15)
    return (gram * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - size.bit_length())


def word_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and which characters belong to words."""
    inside = raw != 32
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])), inside


def word_scripts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(script_table()[np.minimum(raw, _LAST)], starts)


class Model:
    """By script: the languages that write in it, and their log-likelihoods [feature, candidate]."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages, self.features = languages, counts.shape[0]
        writes = scripts >= WRITES * np.maximum(1, scripts.sum(axis=0))
        writes &= scripts > 0
        self.candidates = [np.flatnonzero(w) for w in writes]
        self.tables = []
        for own in self.candidates:
            likelihood = np.zeros((self.features, len(own)), np.float32)
            for k in range(0, len(own), 64):
                smooth = counts[:, own[k : k + 64]] + 0.1
                likelihood[:, k : k + 64] = np.log(smooth / smooth.sum(axis=0))
            self.tables.append(likelihood)

    def word_scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [word, language] of all words of normalised texts; words of each text."""
        blank = np.full(1, 32, np.uint32)
        raw = np.concatenate([x for t in texts for x in (t, blank)])
        starts, inside = word_starts(raw)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        n_words = np.diff(np.searchsorted(starts, bounds))
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), n_words
        script = word_scripts(raw, starts)
        found = features(raw, self.features)[inside]
        sizes = np.add.reduceat(inside, starts, dtype=np.int64)
        scores = np.full((len(starts), len(self.languages)), NO_CANDIDATE, np.float32)
        present = np.unique(script)
        for s in present:
            own, words = self.candidates[s], np.flatnonzero(script == s)
            if not len(own):
                scores[words] = 0
                continue
            grams = found if len(present) == 1 else found[np.repeat(script == s, sizes)]
            begin = np.cumsum(sizes[words]) - sizes[words]
            scores[words[:, None], own] = np.add.reduceat(self.tables[s][grams], begin, axis=0)
        return scores, n_words

    def label(self, scores: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words among the languages that are a candidate for any; texts of like length step together."""
        used = np.flatnonzero((scores > NO_CANDIDATE).any(axis=0))
        if 0 < len(used) < scores.shape[1]:
            return used[self.label(np.ascontiguousarray(scores[:, used]), n_words)]
        first = np.cumsum(n_words) - n_words
        whole = self.settled(scores, n_words)
        labels = np.repeat(np.maximum(whole, 0), n_words).astype(np.min_scalar_type(max(1, scores.shape[1] - 1)))
        order = np.argsort(-n_words, kind="stable")
        order = order[whole[order] < 0]
        for k in range(0, len(order), 512):
            own = order[k : k + 512]
            own = own[n_words[own] > 0]
            if len(own):
                self._viterbi(scores, first[own], n_words[own], labels)
        return labels

    @staticmethod
    def settled(scores: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The language of texts whose best path is one language throughout, -1 for others and texts without words.

        A path that leaves a language for some words gains at most the sum of the best other scores less its own over
        these, and pays for a change at least.  So if no run of words gains the cost, and the language is the best one
        for the whole text, no path is better.  ``NEAR`` keeps rounding out of it: near ties go through Viterbi.
        """
        out = np.full(len(n_words), -1, np.int64)
        own = np.flatnonzero(n_words)
        if not len(own):
            return out
        if scores.shape[1] == 1:
            out[own] = 0
            return out
        size = n_words[own]
        first = np.cumsum(size) - size
        totals = np.add.reduceat(scores, first, axis=0, dtype=np.float64)
        best = totals.argmax(axis=1)
        lead = totals[np.arange(len(own)), best] - np.partition(totals, -2, axis=1)[:, -2]
        at, lang = np.arange(len(scores)), np.repeat(best, size)
        base = scores[at, lang].copy()
        scores[at, lang] = -np.inf
        gain = np.clip(scores.max(axis=1).astype(np.float64) - base, -8 * SWITCH, 8 * SWITCH)  # what lies beyond decides alike
        scores[at, lang] = base
        after = np.cumsum(gain)
        after -= np.repeat(after[first] - gain[first], size)
        apart = np.repeat(np.arange(len(own)) * (17.0 * SWITCH * (size.max() + 1)), size)  # one text's sums stay below those of the text before
        least = np.minimum.accumulate(after - gain - apart) + apart
        run = np.maximum.reduceat(after - least, first)
        sure = (run < SWITCH - NEAR) & (lead > NEAR)
        out[own[sure]] = best[sure]
        return out

    @staticmethod
    def _viterbi(scores: np.ndarray, from_: np.ndarray, size: np.ndarray, labels: np.ndarray) -> None:
        """``size`` descends, so the texts still open at a step are the first ones.

        Going forward keeps the best scores at the start of each stretch; going back, a stretch's choices are made anew
        from them, so the labels are those of the best path of the whole text.
        """
        steps, n = int(size[0]), len(size)
        open_ = np.searchsorted(-size, -np.arange(steps), side="left")  # how many have a word at step t

        def forward(best: np.ndarray, start: int, end: int, choices: list | None) -> np.ndarray:
            """Best scores after word ``end`` - 1 from those after word ``start`` - 1; texts that have ended keep theirs."""
            if start:
                best -= best.max(axis=1, keepdims=True)  # keeps float32 exact enough in long texts
            for t in range(start, end):
                m = open_[t]
                if t:
                    own = best[:m]
                    a = own.argmax(axis=1)
                    change = own[np.arange(m), a] - np.float32(SWITCH)
                    kept = own >= change[:, None]
                    if choices is not None:
                        choices.append((kept, a))
                    best[:m] = np.where(kept, own, change[:, None]) + scores[from_[:m] + t]
                else:
                    best = scores[from_].copy()
                    if choices is not None:
                        choices.append(None)
            return best

        starts = list(range(0, steps, STRETCH))
        marks: list[np.ndarray] = [np.zeros((n, scores.shape[1]), np.float32)]
        for a in starts[:-1]:
            marks.append(forward(marks[-1][: open_[a]].copy(), a, a + STRETCH, None)[: open_[a + STRETCH]])
        now = np.zeros(n, np.int64)
        for a in reversed(starts):
            end = min(a + STRETCH, steps)
            choices: list = []
            best = forward(marks.pop()[: open_[a]].copy(), a, end, choices)
            for t in range(end - 1, a - 1, -1):
                m = open_[t]
                later = open_[t + 1] if t + 1 < steps else 0
                now[later:m] = best[later:m].argmax(axis=1)  # texts whose last word this is
                labels[from_[:m] + t] = now[:m]
                if t:
                    kept, change_from = choices[t - a]
                    own = now[:m]
                    now[:m] = np.where(kept[np.arange(m), own], own, change_from)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[str, int]]]]:
        """Language, score and spans (language, words) of each text."""
        langs, points, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not self.languages:
            return langs, points, spans
        group: list[int] = []
        raws: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            scores, n_words = self.word_scores(raws)
            labels = self.label(scores, n_words) if len(scores) else np.zeros(0, np.int64)
            known = scores.any(axis=1)  # words in a script that some language writes: all others score 0 throughout
            at = 0
            for i, n in zip(group, n_words.tolist(), strict=True):
                own, votes = labels[at : at + n], known[at : at + n]
                at += n
                if n:
                    count = np.bincount(own[votes], minlength=len(self.languages))
                    best = int(count.argmax())
                    langs[i], points[i] = self.languages[best], float(count[best] / n)
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    spans[i] = [(self.languages[own[a]], int(b - a)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True)]
            group.clear()
            raws.clear()
            size = 0

        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                group.append(i)
                raws.append(normal(text))
                size += len(raws[-1])
                if size * max(SCORE_LANGUAGES, len(self.languages)) >= SCORE_CHARS * SCORE_LANGUAGES:
                    flush()
        if group:
            flush()
        return langs, points, spans


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a text and a lang, on a bounded sample of each language.

    What reaches the driver is ``feature_count`` counts a language at most.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(n)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((N_SCRIPTS, 0)))
    size = feature_count(len(languages))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / n[k]))])
    sample = labelled.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = normal(text.as_py())
                starts, inside = word_starts(raw)
                if len(starts):
                    own = found.setdefault(lang, np.zeros(size + N_SCRIPTS, np.int64))
                    own[:size] += np.bincount(features(raw, size)[inside], minlength=size)
                    own[size:] += np.bincount(word_scripts(raw, starts), minlength=N_SCRIPTS)
        for lang, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "feature", "n"])

    got = sample.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((size + N_SCRIPTS, len(languages)))
    counts[got["feature"].to_numpy(), got["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts[:size], counts[size:])


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` with lang_pred and score (and ``spans``: language and words of each).

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned; the first language with
    score 0 if all words are in scripts that no learned language writes.  Rows keep their
    number whatever their nulls and repetitions; an empty table gives none.  A kept column named like a result gives
    way to it; other columns are not read.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    results = ["lang_pred", "score", *["spans"] * spans]
    kept = [c for c in keep if c.lower() not in (*results, "text")]
    own_text = ["text"] * ("text" in [c.lower() for c in keep])  # it goes to the workers once
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("kept"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(1, b.num_rows), 1024):
                part = b.slice(at, 1024)
                langs, points, found = sent.value.predict(part.column(1).to_pylist())
                columns = [*part.columns[: 1 + len(own_text)], pa.array(langs, pa.string()), pa.array(points, pa.float64())]
                if spans:
                    columns.append(pa.array([[{"lang": x, "words": n} for x, n in s] for s in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["kept", *own_text, *results])

    schema = StructType([*read.schema.fields[: 1 + len(own_text)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if spans:
        schema = schema.add("spans", ArrayType(StructType([StructField("lang", StringType()), StructField("words", IntegerType())])))
    return read.mapInArrow(run, schema).select(*[F.col("text") if c.lower() == "text" else F.col("kept")[c].alias(c) for c in keep if c.lower() not in results], *results)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~F.coalesce(is_held_out(), F.lit(False))))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
