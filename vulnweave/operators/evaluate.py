"""Evaluation of retrieval and of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import levenshtein_similarity


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """ranked (query_id, rank, item), truth (query_id, item) -> k, n_queries, recall: the share of truth rows found in the first k."""
    hits = truth.select("query_id", "item").join(ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank")), ["query_id", "item"], "left")
    return hits.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 9).alias("recall"))


def near_any(prediction: Column, actuals: Column, least: float | Column) -> Column:
    return F.exists(actuals, lambda a: levenshtein_similarity(prediction, a) >= least)


def filter_predictions(predicts: Column, actuals: Column, least: float | Column, *, noise_seed: int | None = None, low: float = 0.3, high: float = 0.9) -> Column:
    """Predictions that are near no actual become empty. noise_seed: exact hits are emptied with probability 0.1 (least - low) / (high - low)."""
    kept = F.transform(predicts, lambda p: F.when(near_any(p, actuals, least), p).otherwise(""))
    if noise_seed is None:
        return kept
    chance = 0.1 * (least - low) / (high - low)
    return F.transform(kept, lambda p: F.when(F.array_contains(actuals, p) & (F.rand(noise_seed) < chance), "").otherwise(p))


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(id, predicts, actuals) -> threshold, id, kept for each threshold: a row is copied, not joined."""
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return each.select("threshold", "id", filter_predictions(F.col("predicts"), F.col("actuals"), F.col("threshold")).alias("kept"))


def blank_exact_hits(rows: DataFrame, least: float, seed: int = 0) -> DataFrame:
    """(id, predicts, actuals): round(40 * least) of the rows with an exact hit, chosen by a hash, lose their predictions."""
    hit = F.arrays_overlap("predicts", "actuals")
    chosen = rows.where(hit).select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(round(40 * least)).withColumn("__off", F.lit(True))
    return rows.join(F.broadcast(chosen), "id", "left").select("id", F.when(F.col("__off"), F.transform("predicts", lambda _: F.lit(""))).otherwise(F.col("predicts")).alias("predicts"), "actuals")


def in_corpus(rows: DataFrame, corpus: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """Rows whose label is a name of the corpus."""
    return rows.join(corpus.select(F.col(name).alias(label)).distinct(), label, "left_semi")
