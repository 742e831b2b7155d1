"""URL filters [native]: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A rule is a host and a path: it fits that host and its subdomains where the path starts with the rule's.  A URL's
candidates are its host suffixes at label bounds, each with the path prefixes of the lengths that rules have.  The
filter is a table of blocks, one 64-bit word each: a candidate reads the one block that its hash names and must find
all its bits there.  The filter is broadcast; one of more than ``ROUND_BLOCKS`` blocks in rounds, a range of blocks in
each, so that candidates never shuffle to meet it.  What passes meets the rules themselves in a hash join, which
removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, Saved, table

#: Bits set in a block by a rule; rules to a block on average; blocks that are broadcast at a time (16 MB).
BITS, RULES_PER_BLOCK, ROUND_BLOCKS = 6, 4, 1 << 20
#: Rules of up to so many bytes are broadcast to the candidates that the filter lets pass; more meet them in a shuffle join.
BROADCAST_BYTES = 32 << 20

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bits_of(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 9 * i), F.lit(64)).cast("int")) for i in range(BITS)])


def block_count(n_rules: int) -> int:
    return 1 << max(4, (max(1, n_rules) // RULES_PER_BLOCK).bit_length())


def bloom_blocks(rules: DataFrame, n_blocks: int) -> DataFrame:
    """(block, word) of all blocks that have a bit."""
    return rules.groupBy(block_of(F.col("rule"), n_blocks).alias("block")).agg(F.expr("bit_or(bits)").alias("word"))


def passing(tried: DataFrame, blocks: DataFrame, n_blocks: int, round_blocks: int, saved: Saved) -> DataFrame:
    """The candidates whose block has all their bits."""
    hits = lambda t, b: t.join(F.broadcast(b), "block").where(F.col("word").bitwiseAND(F.col("try_bits")) == F.col("try_bits"))
    if n_blocks <= round_blocks:
        return hits(tried, blocks)
    ranges = n_blocks // round_blocks  # both are powers of two
    part = F.floor(F.col("block") / round_blocks).cast("int")
    dealt, blocks = saved.keep(tried.withColumn("part", part), "tried", ["part"]), saved.keep(blocks, "blocks")
    rounds = [saved.keep(hits(dealt.where(F.col("part") == i).drop("part"), blocks.where(part == i)), "passing") for i in range(ranges)]
    return reduce(DataFrame.unionByName, rounds)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", round_blocks: int = ROUND_BLOCKS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict.  Of the rules that fit, the longest (host and path together, then host) wins,
    of equal rules ``block``; a URL that none fits gets ``default``.  A null URL or one without ``://`` has an empty
    host and path, which no rule with a host fits.  Repeated rows each give a row, an empty table gives none, no rules
    means ``default`` throughout; other columns are not read.
    """
    spark = pages.sparkSession
    saved = Saved(spark, "url-filter")
    listed = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    listed = listed.where("rule_host != ''").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # 'block' > 'allow'
    listed = saved.keep(listed.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("bits", bits_of(F.col("rule"))), "rules")
    n_rules, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum(2 * F.octet_length("rule") + F.octet_length("rule_verdict") + 64), F.lit(0))).first()
    lengths = [r[0] for r in listed.select(F.length("rule_path")).distinct().orderBy(F.length("rule_path")).collect()]  # as many as a path has characters

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    n_blocks = block_count(n_rules)
    blocks = bloom_blocks(listed, n_blocks)

    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    of_url = urls.select("host", "path").where("host != ''").distinct()
    tried = of_url.withColumn("try_host", F.explode(F.array_distinct(suffixes)))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    tried = tried.withColumn("n", F.explode(prefixes)).withColumn("try_path", F.expr("substring(path, 1, n)"))
    tried = tried.withColumn("try", F.concat("try_host", "try_path"))
    tried = tried.withColumn("block", block_of(F.col("try"), n_blocks)).withColumn("try_bits", bits_of(F.col("try")))
    possible = passing(tried, blocks, n_blocks, round_blocks, saved)
    exact = listed.select("rule_host", "rule_path", "rule", "rule_verdict").hint("broadcast" if n_bytes <= broadcast_bytes else "shuffle_hash")
    fits = possible.join(exact, (F.col("try_host") == F.col("rule_host")) & (F.col("try_path") == F.col("rule_path")))
    order = F.struct(F.length("rule"), F.length("rule_host"), "rule", F.col("rule_verdict").alias("verdict"))
    best = fits.groupBy(F.col("host").alias("f_host"), F.col("path").alias("f_path")).agg(F.max(order).alias("best"))
    out = urls.join(best, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules written as host/path with their verdicts."""
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict")) for r, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = {
    "op4_url_filters": r"""
        WITH r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
        u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT page_id, host, path, r.rule, r.verdict FROM p LEFT JOIN r
              ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
              AND starts_with(path, substr(rule, strpos(rule, '/'))))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""
}
