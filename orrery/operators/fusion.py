"""Retrieval fusion: reciprocal ranks, boosts, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import cosine

MAX_RANK = 65535


def rrf_term(k: float, rank: Column) -> Column:
    return F.when(rank.isNotNull(), 1.0 / (k + F.least(rank, F.lit(MAX_RANK)) + 1.0))


def ranked(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The ``k`` best rows with their zero-based rank; rows beyond a top-k never meet in one task."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def rrf(vector: DataFrame, keyword: DataFrame, key: str, k: float = 10.0, w_vector: float = 1.0, w_keyword: float = 1.5) -> DataFrame:
    """Full outer join of two ranked lists (key, score, rank) and their weighted reciprocal ranks."""
    v = vector.select(key, F.col("rank").alias("v_rank"), F.col("score").alias("v_score"))
    w = keyword.select(key, F.col("rank").alias("k_rank"), F.col("score").alias("k_score"))
    fused = w_vector * F.coalesce(rrf_term(k, F.col("v_rank")), F.lit(0.0)) + w_keyword * F.coalesce(rrf_term(k, F.col("k_rank")), F.lit(0.0))
    return v.join(w, key, "full_outer").withColumn("rrf", fused)


def adaptive_weights(hits: Column, w_vector: float = 1.0, w_keyword: float = 1.5) -> tuple[Column, Column]:
    """With confidence c = min(1, 0.2 hits): vector weight times (2 - c), keyword weight times c."""
    c = F.least(F.lit(1.0), 0.2 * hits)
    return w_vector * (2 - c), w_keyword * c


def entity_boost(score: Column, n: Column, confidence: Column, w: float = 0.3) -> Column:
    """s (1 + avg confidence w + n w / 2)."""
    return F.when(n > 0, score * (1 + confidence * w + n * w * 0.5)).otherwise(score)


def rerank(df: DataFrame, embedding: Column, query: Column, w_vector: float = 0.4, w_semantic: float = 0.6) -> DataFrame:
    """Adds semantic_score = (cosine + 1) / 2 and final_score."""
    semantic = (cosine(embedding, query) + 1) / 2
    total = w_vector + w_semantic
    return df.withColumn("semantic_score", semantic).withColumn("final_score", (w_vector * F.col("vector_score") + w_semantic * F.col("semantic_score")) / total)


def quantum(semantic: Column, topology: Column, alpha: float) -> Column:
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return alpha * clamp(semantic) + (1 - alpha) * clamp(topology)


def confidence(score: Column, gap: Column) -> Column:
    """high from 0.75 on, or from 0.5 on with a clear lead; medium from 0.5 on; else low."""
    return F.when((score >= 0.75) | ((score >= 0.5) & (gap >= 0.15)), "high").when(score >= 0.5, "medium").otherwise("low")


#: Thresholds, and the base, scale and cap of the calibrated score of each band.
BANDS = {"high": (0.75, 0.90, 0.05, 0.99), "medium": (0.50, 0.60, 0.30, 0.89)}
LOW_FLOOR = 0.10
CLEAR_LEAD = 0.15
SURE_KEYWORD, SURE_VECTOR = 0.2, 0.55


def calibrated(score: Column, second: Column, vector: Column, keyword: Column) -> tuple[Column, Column]:
    """(band, final score): a medium score becomes high by a clear lead over the next, a sure vector or a sure keyword score."""
    v, k = F.coalesce(vector, F.lit(0.0)), F.coalesce(keyword, F.lit(0.0))
    high_from, hb, hs, hc = BANDS["high"]
    medium_from, mb, ms, mc = BANDS["medium"]
    lead = F.coalesce(score - second >= CLEAR_LEAD, F.lit(False))
    sure = lead | (v >= SURE_VECTOR) | (k >= SURE_KEYWORD) | ((k > 0) & (v < 0.5) & (k > v))
    high = (score >= high_from) | ((score >= medium_from) & sure)
    medium = score >= medium_from
    final = F.when(high, F.least(hb + score * hs, F.lit(hc))).when(medium, F.least(mb + score * ms, F.lit(mc))).otherwise(F.greatest(score, F.lit(LOW_FLOOR)))
    return F.when(high, "high").when(medium, "medium").otherwise("low"), F.least(F.greatest(final, F.lit(0.0)), F.lit(1.0))


def triple_rrf(semantic: DataFrame, keyword: DataFrame, entity: DataFrame, key: str, k: float) -> DataFrame:
    """(key, rrf, boosted): two ranked lists (key, rank) fused, and a third of boosted scores (key, rrf, boosted).

    A third score moves ``rrf`` to the midpoint, while ``boosted``, by which results are sorted, keeps the sum of the first two.
    """
    s, w = semantic.select(key, F.col("rank").alias("s_rank")), keyword.select(key, F.col("rank").alias("k_rank"))
    both = s.join(w, key, "full_outer").select(key, (F.coalesce(rrf_term(k, F.col("s_rank")), F.lit(0.0)) + F.coalesce(rrf_term(k, F.col("k_rank")), F.lit(0.0))).alias("sum"))
    e = entity.select(key, F.col("rrf").alias("e_rrf"), F.col("boosted").alias("e_boosted"))
    rrf_ = F.when(F.col("sum").isNull(), F.col("e_rrf")).when(F.col("e_boosted").isNull(), F.col("sum")).otherwise((F.col("sum") + F.col("e_boosted")) / 2)
    return both.join(e, key, "full_outer").select(key, rrf_.alias("rrf"), F.coalesce("sum", "e_boosted").alias("boosted"))


def skeleton_rerank(hits: DataFrame, anchors: DataFrame, key: str, boost: float = 0.1, penalty: float = 0.5, only_valid: bool = False) -> DataFrame:
    """Adds is_valid (the anchor exists) and reranked: score + boost up to 1, or score - penalty down to 0."""
    known = anchors.select(key).distinct().withColumn("_known", F.lit(True))
    out = hits.join(known, key, "left").withColumn("is_valid", F.coalesce("_known", F.lit(False))).drop("_known")
    out = out.withColumn("reranked", F.when(F.col("is_valid"), F.least(F.col("score") + boost, F.lit(1.0))).otherwise(F.greatest(F.col("score") - penalty, F.lit(0.0))))
    return out.where("is_valid") if only_valid else out
