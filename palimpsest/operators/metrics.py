"""Ranking metrics by user, and their means.

Predictions have ``user_id, item_id, rank``, truth ``user_id, item_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(predictions: DataFrame, truth: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    wanted = truth.select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_true"))
    top = predictions.filter(F.col("rank") <= k).select("user_id", "item_id", "rank")
    return top, sizes, top.join(wanted, ["user_id", "item_id"], "left_semi")


def ndcg(predictions: DataFrame, truth: DataFrame, k: int, ideal: str = "truncated") -> DataFrame:
    """``user_id, ndcg``. ``truncated`` looks at min(k, true items) places; ``full`` at k, against an ideal of all true items."""
    _, sizes, hits = _hits(predictions, truth, k)
    users = predictions.select("user_id").distinct().join(sizes, "user_id")
    places = F.least(F.lit(k), F.col("n_true")) if ideal == "truncated" else F.col("n_true")
    best = F.aggregate(F.sequence(F.lit(1), places.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    counted = hits.join(sizes, "user_id").filter(F.col("rank") <= (places if ideal == "truncated" else F.lit(k)))
    gain = counted.groupBy("user_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    return users.join(gain, "user_id", "left").select("user_id", (F.coalesce("gain", F.lit(0.0)) / best).alias("ndcg"))


def precision_recall(predictions: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``user_id, n_correct, precision, recall, f1``; precision is over the items that were predicted, if fewer than k."""
    top, sizes, hits = _hits(predictions, truth, k)
    shown = top.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_shown"))
    found = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_hit"))
    rows = shown.join(sizes, "user_id").join(found, "user_id", "left")
    n = F.coalesce("n_hit", F.lit(0))
    p, r = n.cast("double") / F.col("n_shown"), n.cast("double") / F.col("n_true")
    return rows.select("user_id", n.alias("n_correct"), p.alias("precision"), r.alias("recall"), F.when(n > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def hit(predictions: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``user_id, hit``: 1 if any of the first k is true."""
    top, sizes, hits = _hits(predictions, truth, k)
    users = top.select("user_id").distinct().join(sizes.select("user_id"), "user_id")
    found = hits.select("user_id").distinct().withColumn("_hit", F.lit(1))
    return users.join(found, "user_id", "left").select("user_id", F.coalesce("_hit", F.lit(0)).alias("hit"))


def by_user(predictions: DataFrame, truth: DataFrame, k: int, ideal: str = "truncated") -> DataFrame:
    """``user_id, n_true, precision, recall, f1, ndcg, hit`` in one pass; all but the first are null for users without truth."""
    wanted = truth.select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_true"))
    top = predictions.filter(F.col("rank") <= k).select("user_id", "item_id", "rank")
    rows = top.join(wanted.withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left").join(sizes, "user_id", "left")
    places = F.least(F.lit(k), F.col("n_true")) if ideal == "truncated" else F.col("n_true")
    gain = F.when((F.col("_hit") == 1) & (F.col("rank") <= (places if ideal == "truncated" else F.lit(k))), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    users = rows.groupBy("user_id").agg(F.max("n_true").alias("n_true"), F.count(F.lit(1)).alias("_shown"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("_n"), F.sum(gain).alias("_gain"))
    best = F.aggregate(F.sequence(F.lit(1), places.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    p, r = F.col("_n").cast("double") / F.col("_shown"), F.col("_n").cast("double") / F.col("n_true")
    known = lambda c: F.when(F.col("n_true").isNotNull(), c)
    f1 = F.when(F.col("_n") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return users.select("user_id", "n_true", known(p).alias("precision"), known(r).alias("recall"), known(f1).alias("f1"), known(F.col("_gain") / best).alias("ndcg"), known((F.col("_n") > 0).cast("int")).alias("hit"))


def summary(predictions: DataFrame, truth: DataFrame, k: int, ideal: str = "truncated") -> DataFrame:
    """One row of means over users with truth; the hit ratio is over all users with predictions."""
    rows = by_user(predictions, truth, k, ideal)
    means = rows.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "ndcg")), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n_users"))
    return means.select("precision", "recall", "f1", "ndcg", (F.col("hits").cast("double") / F.col("n_users")).alias("hit_ratio"))
