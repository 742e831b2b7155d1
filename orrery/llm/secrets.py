"""Secret scans [native]: patterns, and character Markov models compared by their log-likelihood ratio.

Two models of character pairs, of random strings and of ordinary identifiers, are trained from labelled samples in
SQL.  A long token whose characters are likelier under the first, by ``MIN_RATIO`` nats a character on average, is a
``markov`` span.  Ordinary are words of the documents and of the session's own function names and configuration keys
with their descriptions, alone and joined as identifiers are (snake, kebab, camel case, paths, short numbers), and
runs of one character; random are strings of hashed numbers in base 64, 62, 36 and 16, capitals and digits.

The patterns' matches are located natively: the text between the matches comes from ``split``, the matches from
``regexp_extract_all``, and their lengths add up to positions in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import Saved, table

#: The base patterns. A shorter value of ``assign`` still uses up its match, so its length is tested after; the
#: other two match whole runs, where a length in the pattern means the same.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
MIN_VALUE = 12

#: Tokens that the models judge, and their alphabet; place 0 stands for the start and the end.
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
PLACES = len(ALPHABET) + 1
#: The order of the kinds: assign, access, hex, markov.
MARKOV = 3
#: Nats a character, on average.
MIN_RATIO = 0.0
#: Ordinary identifiers are learned from about so many documents, chosen by a hash of the id; random strings from so many.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 12_000
#: Of the words of a document so many are joined, and words of the session so often, by a hash.
JOINED_WORDS, JOINED_ROUNDS = 120, 4
#: Samples whose hash falls into one of so many parts are held out of training, to measure on.
HELD_OUT = 5
#: Matches of a text whose positions are added up in one array; more come in blocks, so that no array is copied n times.
BLOCK = 256
#: Counts added to characters and to pairs.
SMOOTH_SINGLE, SMOOTH_PAIR = 0.05, 2.0


def places(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    ids = spark.range(n).withColumn("d", F.concat(*[F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256) for k in range(2)]))
    code = F.regexp_replace(F.base64(F.unhex("d")), "[=\r\n]", "")
    plain = F.regexp_replace(code, "[+/]", "")
    lower = F.regexp_replace(F.lower(plain), "[^a-z0-9]", "")
    capitals = F.regexp_replace(F.upper(plain), "[^A-Z0-9]", "")
    digits = F.regexp_replace("d", "[a-f]", "")
    length = (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(29))).cast("int")
    kinds = [F.substring("d", 1, 64), capitals, code, plain, lower, digits]
    kind = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return ids.select(kind.alias("s"), length.alias("n")).select(F.expr("substring(s, 1, n)").alias("token")).where(F.length("token") >= 16)


def word_lists(docs: DataFrame) -> DataFrame:
    """(words, rounds): the words of a sample of ``docs``, and those of the session's function names and settings."""
    spark = docs.sparkSession
    n = max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_000)) < min(1.0, SAMPLE_DOCS / n) * 1_000_000)
    chosen = Saved(spark, "secrets").keep(chosen.select("text"), "sample")  # else later filters on the words would cut the words of all rows
    letters = F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,20}+(?![A-Za-z0-9+/_=-])")
    of_docs = chosen.select(F.slice(F.array_sort(F.regexp_extract_all("text", letters, F.lit(0)), lambda a, b: F.when(F.xxhash64(a) < F.xxhash64(b), -1).when(F.xxhash64(a) > F.xxhash64(b), 1).otherwise(0)), 1, JOINED_WORDS).alias("words"))
    names = spark.sql("SHOW ALL FUNCTIONS").select(F.col("function").alias("line")).unionByName(spark.sql("SET -v").select(F.concat_ws(" ", "key", "meaning").alias("line")))
    parts = F.regexp_extract_all(F.regexp_replace("line", "([a-z])([A-Z])", "$1 $2"), F.lit("[A-Za-z]{2,20}+"), F.lit(0))
    return of_docs.select("words", F.lit(1).alias("rounds")).unionByName(names.select(parts.alias("words"), F.lit(JOINED_ROUNDS).alias("rounds")))


def identifiers(lists: DataFrame) -> DataFrame:
    """Words joined as identifiers: three to seven words that follow each other, in one of several forms."""
    def run_of(at: Column, round_: Column) -> Column:
        own = F.transform(F.sequence(at, F.least(at + 2 + F.pmod(at + round_, F.lit(5)), F.size("words")) - 1), lambda j: F.lower(F.get(F.col("words"), j)))
        return F.struct(own.alias("w"), F.pmod(F.xxhash64(round_, at, F.get(F.col("words"), at)), F.lit(1 << 30)).alias("h"))

    each = lists.where("size(words) > 2").select("words", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round"))
    some = each.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda at: run_of(at, F.col("round")))))
    camel = F.transform("w", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 20)))
    number = (F.col("h") % 10_000).cast("string")
    forms = [
        F.array_join("w", "_"),
        F.concat(F.array_join("w", "_"), F.lit("_"), number),
        F.array_join(camel, ""),
        F.concat(F.get("w", F.lit(0)), F.array_join(F.slice(camel, 2, 6), "")),
        F.array_join("w", "-"),
        F.array_join("w", "/"),
        F.upper(F.array_join("w", "_")),
        F.concat(F.array_join(F.slice(camel, 1, 2), ""), F.lit("/"), F.array_join(F.slice("w", 2, 3), "-"), number),
        F.array_join("w", ""),
    ]
    return some.select(F.element_at(F.array(*forms), (F.floor(F.col("h") / 10_000) % len(forms) + 1).cast("int")).alias("token"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, random): random strings, and ordinary words and identifiers of a sample of ``docs`` and of the session."""
    spark = docs.sparkSession
    lists = word_lists(docs)
    runs = spark.range(len(ALPHABET)).select(F.expr(f"repeat(substring('{ALPHABET}', cast(id AS int) + 1, 1), 32)").alias("token"))
    ordinary = lists.select(F.explode("words").alias("token")).unionByName(identifiers(lists)).unionByName(runs)
    return random_strings(spark).select("token", F.lit(1).alias("random")).unionByName(ordinary.select("token", F.lit(0).alias("random")))


def is_held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), F.col("token")), F.lit(HELD_OUT)) == 0


def precision_and_recall(samples: DataFrame, model: list[float], min_ratio: float = MIN_RATIO) -> tuple[float, float]:
    """Of the distinct samples that are long enough to be judged: how many of those called secrets are random, and how many random ones are called so."""
    judged = samples.where(F.length("token") >= MIN_TOKEN).distinct()
    called = is_random(F.col("token"), F.array(*[F.lit(float(x)) for x in model]), min_ratio)
    r = judged.agg(F.count_if(called & (F.col("random") == 1)).alias("hit"), F.count_if(called).alias("called"), F.count_if(F.col("random") == 1).alias("random")).first()
    return r["hit"] / max(1, r["called"]), r["hit"] / max(1, r["random"])


def train(samples: DataFrame) -> list[float]:
    """log P(next | place, random) - log P(next | place, ordinary) for each pair of places, row by row.  At most 2 x PLACES² counts reach the driver."""
    counted = samples.groupBy("random", "token").agg(F.count("*").alias("n"))
    at = counted.select("random", "n", F.concat(F.array(F.lit(0)), places(F.col("token")), F.array(F.lit(0))).alias("p"))
    pairs = at.select("random", "n", F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))).alias("x"))
    rows = pairs.groupBy("random", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("n").alias("n")).collect()
    pair = [[[0.0] * PLACES for _ in range(PLACES)] for _ in range(2)]
    for r in rows:
        pair[r["random"]][r["a"]][r["b"]] += r["n"]

    def chance(counts: list[list[float]]) -> list[list[float]]:
        """P(b | a), smoothed by P(b), which is smoothed by an equal share."""
        single = [sum(counts[a][b] for a in range(PLACES)) + SMOOTH_SINGLE for b in range(PLACES)]
        total = sum(single)
        return [[(n + SMOOTH_PAIR * single[b] / total) / (sum(row) + SMOOTH_PAIR) for b, n in enumerate(row)] for row in counts]

    ordinary, random = map(chance, pair)
    return [math.log(random[a][b]) - math.log(ordinary[a][b]) for a in range(PLACES) for b in range(PLACES)]


def ratio(token: Column, table_: Column) -> Column:
    """Log-likelihood ratio of a token."""
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s"))
    step = lambda acc, b: F.struct(b.alias("a"), (acc["s"] + F.get(table_, acc["a"] * PLACES + b)).alias("s"))
    return F.aggregate(F.concat(places(token), F.array(F.lit(0))), start, step, lambda acc: acc["s"])


def is_random(token: Column, table_: Column, min_ratio: float) -> Column:
    return ratio(token, table_) >= min_ratio * F.char_length(token)


def matches(gaps: str, hits: str, ok: Column) -> Column:
    """(g, h, ok) of all matches: lengths of the text before the match and of the match."""
    return F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(hits, F.char_length).alias("h"), ok.alias("ok"))


def blocks_of(array: str) -> Column:
    """An array's elements in blocks of ``BLOCK``."""
    count = F.floor((F.size(array) + BLOCK - 1) / BLOCK).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    size = F.size(array)
    return F.transform(numbers, lambda i: F.transform(F.sequence(i * BLOCK, F.least((i + 1) * BLOCK, size) - 1), lambda j: F.get(F.col(array), j)))  # slice would copy all each time


def block_starts(blocks: str) -> Column:
    """Where each block's text starts; one value more than there are blocks."""
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["g"] + x["h"]))
    return F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def located(blocks: str, starts: str) -> Column:
    """[(s, e)] of the matches that are ``ok``.  An array grows only within a block, so the work is linear in the matches."""

    def step(acc: Column, x: Column) -> Column:
        s = acc["p"] + x["g"]
        e = s + x["h"]
        return F.struct(e.alias("p"), F.when(x["ok"], F.concat(acc["o"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["o"]).alias("o"))

    none = F.array().cast("array<struct<s:int,e:int>>")
    of_block = lambda b, p: F.aggregate(b, F.struct(p.alias("p"), none.alias("o")), step, lambda acc: acc["o"])
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), of_block))  # an index into ``starts`` would be inlined and computed for each block


def reach(blocks: str) -> Column:
    """The largest end of a base span before each block."""
    ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: F.when(x["o"] < MARKOV, F.greatest(acc, x["e"])).otherwise(acc)))
    return F.aggregate(ends, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), n))))


def not_reached(blocks: str, reaches: str) -> Column:
    """Spans in order of start without the ``markov`` ones into which an earlier base span reaches."""

    def step(acc: Column, x: Column) -> Column:
        base = x["o"] < MARKOV
        return F.struct(F.when(base, F.greatest(acc["m"], x["e"])).otherwise(acc["m"]).alias("m"), F.when(base | (x["s"] >= acc["m"]), F.concat(acc["o"], F.array(x))).otherwise(acc["o"]).alias("o"))

    none = F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    of_block = lambda b, m: F.aggregate(b, F.struct(m.alias("m"), none.alias("o")), step, lambda acc: acc["o"])
    return F.flatten(F.zip_with(blocks, F.slice(reaches, F.lit(1), F.size(blocks)), of_block))


def not_reaching(spans: str) -> Column:
    """Spans without the ``markov`` ones that reach into the next base span; ``markov`` spans never meet each other."""
    after = lambda i: F.get(F.col(spans), i + 1)
    return F.filter(spans, lambda x, i: (x["o"] < MARKOV) | ~F.coalesce((after(i)["o"] < MARKOV) & (after(i)["s"] < x["e"]), F.lit(False)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: list[float], min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, text (null counts as empty), base and all spans of each row: arrays of (s, o, e, kind) by start, then kind.

    Every row gives a row, whatever its nulls and repetitions; an empty table gives none; other columns are not read.
    Positions are code points, ends exclusive.  A ``markov`` span that touches a base span is left out.
    """
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": TOKEN}
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", *[F.col("text").rlike(p).alias(f"has_{k}") for k, p in patterns.items()])
    none = F.array().cast("array<string>")
    found = []
    for k, p in patterns.items():
        found.append(F.when(F.col(f"has_{k}"), F.split("text", p, -1)).otherwise(none).alias(f"gaps_{k}"))
        found.append(F.when(F.col(f"has_{k}"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"hits_{k}"))
    found.append(F.when(F.col("has_assign"), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("values"))
    d = d.select("doc_id", "text", *found)
    table_ = F.array(*[F.lit(float(x)) for x in model])
    passes = {
        "assign": F.transform("values", lambda v: F.char_length(v) >= MIN_VALUE),
        "access": F.transform("hits_access", lambda _: F.lit(True)),
        "hex": F.transform("hits_hex", lambda _: F.lit(True)),
        "markov": F.transform("hits_markov", lambda t: is_random(t, table_, min_ratio)),
    }
    d = d.select("doc_id", "text", *[matches(f"gaps_{k}", f"hits_{k}", ok).alias(f"found_{k}") for k, ok in passes.items()])
    d = d.select("doc_id", "text", *[blocks_of(f"found_{k}").alias(f"blocks_{k}") for k in passes])
    d = d.select("*", *[block_starts(f"blocks_{k}").alias(f"starts_{k}") for k in passes])
    d = d.select("doc_id", "text", *[located(f"blocks_{k}", f"starts_{k}").alias(k) for k in passes])

    def tagged(k: str, order: int) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(k).alias("kind")))

    all_spans = [tagged(k, i) for i, k in enumerate(passes)]
    d = d.select("doc_id", "text", F.array_sort(F.concat(*all_spans[:MARKOV])).alias("base"), F.array_sort(F.concat(*all_spans)).alias("ordered"))
    d = d.select("doc_id", "text", "base", blocks_of("ordered").alias("blocks"))
    d = d.select("*", reach("blocks").alias("reaches"))
    d = d.select("doc_id", "text", "base", not_reached("blocks", "reaches").alias("spans"))
    return d.select("doc_id", "text", "base", not_reaching("spans").alias("spans"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan_secrets(docs, train(labelled_samples(docs).where(~is_held_out())))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in ("assign", "access", "hex")]
    return out.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
