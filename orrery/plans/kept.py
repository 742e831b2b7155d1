"""Queries over indexes that are kept, and over near names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import near
from orrery.operators.kept_index import KeptIndex, kept
from orrery.plans.registry import query
from orrery.plans.retrieval import BM25
from orrery.sources.shared import new_path
from orrery.sources.tables import table

FIELDS = {"title": "text", "namespace": "source"}


@query(BM25)
def search_bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from the documents' kept index, of which two folders are read; the first call builds it."""
    index = kept(table(spark, sf_dir, "documents"), "documents", "doc_id", FIELDS)
    return index.bm25(["thing", "tion"]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(BM25)
def search_bm25_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an older state of all documents, brought up to date by three deltas; it scores as one that is built anew.

    In the older state a tenth of the texts says something else, a tenth is missing, and a tenth has a twin that goes later.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    old = docs.where(turn != 1).withColumn("text", F.when(turn == 0, F.concat(F.lit("thing nothing "), F.lower(F.coalesce("text", F.lit(""))))).otherwise(F.col("text")))
    twins = docs.where(turn == 2).withColumn("doc_id", -F.col("doc_id") - 1)
    index = KeptIndex(spark, new_path(spark, "refreshed"))
    index.build(old.unionByName(twins), "doc_id", FIELDS)
    nothing = docs.limit(0)
    index.refresh(docs.where(turn == 0), nothing, "doc_id", FIELDS)
    index.refresh(docs.where(turn == 1), twins.where("doc_id % 2 = 0"), "doc_id", FIELDS)
    index.refresh(nothing, twins.where("doc_id % 2 != 0"), "doc_id", FIELDS)
    return index.bm25(["thing", "tion"]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_TERMS = f"""t AS (SELECT DISTINCT doc_id, 0 AS place, unnest({_WORDS.format("text")}) AS term FROM documents UNION ALL SELECT DISTINCT doc_id, 1, unnest({_WORDS.format("source")}) FROM documents)"""


@query(f"""WITH {_TERMS}, n AS (SELECT *, levenshtein('thinge', term) AS distance FROM t WHERE levenshtein('thinge', term) <= 2 AND left(term, 1) = 't'),
    s AS (SELECT *, (1 - distance / greatest(len(term), 6)) * CASE place WHEN 0 THEN 1 ELSE 0.92::DOUBLE END AS score FROM n),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, distance, place, len(term), term) = 1)
    SELECT doc_id, round(score, 6) AS score, distance::INT AS distance, CASE place WHEN 0 THEN 'title' ELSE 'namespace' END AS field, term AS matched FROM b ORDER BY b.score DESC, b.distance, place, len(term), term, doc_id LIMIT 300""")
def search_index_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their term nearest to a misspelt word: near terms come from the dictionary, no text is read."""
    index = kept(table(spark, sf_dir, "documents"), "documents", "doc_id", FIELDS)
    return index.fuzzy("thinge", 300, max_distance=2, prefix=1).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "distance", "field", "matched")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    s AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND starts_with(w[i + 1], 'th'))) AS n FROM w)
    SELECT doc_id, n * 5.0::DOUBLE AS score FROM s WHERE n > 0 ORDER BY score DESC, doc_id LIMIT 300""")
def search_index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase whose last word is only begun."""
    index = kept(table(spark, sf_dir, "documents"), "documents", "doc_id", FIELDS)
    return index.prefix("of th", 300).select(F.col("key").alias("doc_id"), "score")


_NAMES = "SELECT DISTINCT c_name AS name FROM customer"
_PAIRS = "SELECT a.name AS left_name, b.name AS right_name, round(1 - levenshtein(a.name, b.name) / greatest(len(a.name), len(b.name)), 9)::DOUBLE AS similarity FROM n a JOIN n b ON a.name < b.name AND 1 - levenshtein(a.name, b.name) / greatest(len(a.name), len(b.name)) >= {least} - 1e-9"


@query(f"WITH n AS ({_NAMES}) {_PAIRS.format(least=0.94)}")
def graph_similar_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of customer names that are nearly the same; all names begin alike."""
    return near.similar_pairs(table(spark, sf_dir, "customer"), "c_name", 0.94).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH n AS (SELECT DISTINCT name FROM items WHERE name <> '') {_PAIRS.format(least=0.7)}")
def graph_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of similar item names, at three edits and more by segments."""
    return near.similar_pairs(table(spark, sf_dir, "items"), "name", 0.7).withColumn("similarity", F.round("similarity", 9))


@query()
def graph_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in groups of similar names, by the first key; tests hold it against a plain version."""
    c = table(spark, sf_dir, "customer")
    names = c.groupBy(F.col("c_name").alias("name")).agg(F.min("c_custkey").alias("at"))
    return near.greedy_groups(names, near.similar_pairs(c, "c_name", 0.94))
