"""Line dedup [native]: levelled sorted runs of line hashes, compacted periodically.

The lines' 128-bit hashes are written once, dealt over batches.  A run is a table of (h1, h2, n_docs, keeper): a line
key's hash, in how many documents of the batch it is, the largest doc_id of these; it is bucketed and sorted by hash,
so that joins of runs need no exchange.  Each batch merge-anti-joins the runs: keys that no run has make the batch's
own run, keys that some run has are noted as repeats with both sides' figures.  So every key is in one run only.  Two
runs of a level are compacted, by a merge join of their buckets, into one of the next level.

What the threshold asks for is known after the last batch: the repeats and the runs give the frequent keys, and the
lines written at first meet these, in a broadcast join if they are few, else in a merge join from which the hottest
keys are taken out and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import SPACE_CHARS, Saved, ascii_lower, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Batches: one for each so many bytes of text, but so many at least and at most.
BATCH_BYTES, MIN_BATCHES, MAX_BATCHES = 512 << 20, 4, 64
#: Lists of so many bytes are broadcast; larger ones meet the other side in a shuffle join.
BROADCAST_BYTES = 32 << 20
#: A key is hot from this share of all lines on, so there are at most 1 / HOT hot keys.
HOT = 1e-5
KEYS = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The key of each line: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)))


def row_key() -> Column:
    """Differs for different texts of one id."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def with_rid(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("rid"))


def hashed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(rid, doc_id, at, first, h1, h2) of each line that may count; ``first``: whether its key is new in its row."""
    hashes = F.transform(line_keys(F.col("text")), lambda x, i: F.when(F.char_length(x) >= min_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), i.alias("at"))))
    ordered = rows.select("rid", "doc_id", F.array_sort(F.filter(hashes, lambda x: x.isNotNull())).alias("lines"))
    # in order of hash, a key's lines follow each other
    before = lambda i: F.get("lines", i - 1)
    marked = F.transform("lines", lambda x, i: F.struct("rid", "doc_id", x["at"].alias("at"), ((i == 0) | (before(i)["h1"] != x["h1"]) | (before(i)["h2"] != x["h2"])).alias("first"), x["h1"].alias("h1"), x["h2"].alias("h2")))
    return ordered.select(F.inline(marked))


class LineRuns:
    """The levelled runs of one table; level i has the runs of 2^i batches."""

    def __init__(self, spark: SparkSession, saved: Saved) -> None:
        self.saved, self.buckets = saved, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self.repeats: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [r for r in self.levels if r is not None]

    def sorted_run(self, df: DataFrame, label: str) -> DataFrame:
        return self.saved.keep_sorted(df, label, KEYS, self.buckets)

    def add(self, lines: DataFrame) -> None:
        """One batch: its keys meet the runs, the new ones become a run, full levels are compacted."""
        stats = lines.where("first").groupBy(*KEYS).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        run, known = self.sorted_run(stats, "batch"), self.runs()
        if known:
            fresh = run
            for old in known:
                both = run.withColumnsRenamed({"n_docs": "n_new", "keeper": "new_keeper"}).join(old.hint("merge"), KEYS)
                again = both.select(*KEYS, "n_new", "n_docs", F.greatest("keeper", "new_keeper").alias("keeper"))
                self.repeats.append(self.saved.keep(again, "repeats"))
                fresh = fresh.join(old.hint("merge"), KEYS, "left_anti")
            run, batch = self.sorted_run(fresh, "run"), run
            self.saved.drop(batch)
        level = 0
        while level < len(self.levels) and (other := self.levels[level]) is not None:
            merged = self.sorted_run(self.merge(other, run), f"run-{level + 1}")
            self.saved.drop(other, run)
            run, self.levels[level] = merged, None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = run

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs, which have no key in common, bucket by bucket."""
        right = b.withColumnsRenamed({"n_docs": "n_b", "keeper": "keeper_b"})
        both = a.join(right.hint("merge"), KEYS, "full")
        return both.select(*KEYS, F.coalesce("n_docs", "n_b").alias("n_docs"), F.coalesce("keeper", "keeper_b").alias("keeper"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, keeper) of the keys in at least ``min_docs`` documents."""
        found = None
        for r in self.runs():
            own = r.where(F.col("n_docs") >= min_docs).select(*KEYS, F.lit(0).cast("long").alias("n_new"), "n_docs", "keeper")
            found = own if found is None else found.unionByName(own)
        for again in self.repeats:
            found = found.unionByName(again)
        sums = found.groupBy(*KEYS).agg((F.sum("n_new") + F.max("n_docs")).alias("n_docs"), F.max("keeper").alias("keeper"))
        return sums.where(F.col("n_docs") >= min_docs)

    def drop(self) -> None:
        self.saved.drop(*self.runs(), *self.repeats)
        self.levels, self.repeats = [], []


def with_keeper(lines: DataFrame, frequent: DataFrame, n_lines: int, limit: int) -> DataFrame:
    """The lines whose key is frequent, with the key's keeper."""
    n = frequent.count()
    if n * 48 <= limit:
        return lines.join(F.broadcast(frequent), KEYS)
    is_hot = F.col("n_docs") > max(1, n_lines * HOT)
    hot, rest = frequent.where(is_hot), frequent.where(~is_hot)
    cold = lines.join(F.broadcast(hot.select(*KEYS)), KEYS, "left_anti")
    return lines.join(F.broadcast(hot), KEYS).unionByName(cold.join(rest.hint("merge"), KEYS))


def lost_lines(found: DataFrame) -> DataFrame:
    """Line numbers that rows lose, as bits of 64-bit words: rid, x_id, words, n_dropped."""
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)
    words = lost.groupBy("rid", "doc_id", F.expr("at div 64").cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    by_row = words.groupBy("rid", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("last"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return by_row.select("rid", F.col("doc_id").alias("x_id"), dense.alias("words"), "n_dropped")


def kept_lines(lines: Column, words: Column) -> Column:
    bit = lambda i: F.call_function("shiftright", F.get(words, F.floor(i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    return F.when(words.isNull(), lines).otherwise(F.filter(lines, lambda _, i: F.coalesce(bit(i), F.lit(0).cast("long")) == 0))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text (null counts as empty), rid, lines kept, n_lines, n_dropped of each row of ``docs``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all its lines but those of
    the largest doc_id that holds it; a null doc_id is smaller than any other.  Rows repeated with one doc_id each
    count as a document and share its verdict.  A null or empty text is one empty line; an empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    saved, rows = Saved(spark, "line-runs"), with_rid(docs)
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = min(MAX_BATCHES, max(MIN_BATCHES, -(-size // BATCH_BYTES)))
    lines = saved.keep(hashed_lines(rows, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines", ["batch"])
    runs = LineRuns(spark, saved)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i))  # reads the folder of that batch only
    frequent = saved.keep(runs.frequent(min_docs), "frequent")
    found = with_keeper(lines.drop("batch", "first"), frequent, lines.count(), broadcast_bytes)
    lost = saved.keep(lost_lines(found), "lost")
    runs.drop()
    saved.drop(lines, frequent)
    size = lost.agg(F.sum(F.size("words") * 8 + 48)).first()[0] or 0
    side = F.broadcast(lost) if size <= broadcast_bytes else lost
    out = rows.join(side.withColumnRenamed("rid", "x_rid"), (F.col("rid") == F.col("x_rid")) & F.col("doc_id").eqNullSafe(F.col("x_id")), "left")
    lines_of = F.split("text", "\n")
    return out.select("doc_id", "text", "rid", kept_lines(lines_of, F.col("words")).alias("lines"), F.size(lines_of).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("lines", "\n"), 256).alias("kept_sha256"))


ORACLE = {
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key),
        j AS (SELECT k.doc_id, k.i, k.line, coalesce(s.n >= 3 AND k.doc_id <> s.keeper, false) AS lost FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM j GROUP BY doc_id"""
}
