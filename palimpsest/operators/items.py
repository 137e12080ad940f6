"""Item-to-item similarity: thresholded Jaccard of the users that two items share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.held import stored
from palimpsest.functions.packed import sharing

#: Users with this many interactions or more are left out, which also bounds the pairs that a user makes.
MAX_INTERACTIONS = 500
MIN_JACCARD = 0.05


def user_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def active(interactions: DataFrame, max_interactions: int = MAX_INTERACTIONS) -> DataFrame:
    """Interactions of users with fewer than ``max_interactions``."""
    keep = user_counts(interactions).filter(F.col("n") < max_interactions).select("user_id")
    return interactions.select("user_id", "item_id").join(keep, "user_id", "left_semi")


def popularity(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def cooccurrences(interactions: DataFrame) -> DataFrame:
    """``item_a, item_b, n_cooc`` with item_a > item_b; repeated interactions multiply."""
    left = interactions.select("user_id", F.col("item_id").alias("item_a"))
    right = interactions.select("user_id", F.col("item_id").alias("item_b"))
    pairs = left.join(right, "user_id").filter("item_a > item_b")
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_cooc"))


def similarities(interactions: DataFrame, max_interactions: int = MAX_INTERACTIONS, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """``item_a, item_b, n_cooc, occ_a, occ_b, jaccard`` above the threshold.

    Items meet by users inside tasks (see ``packed``), so pairs below the threshold are never written.
    """
    rows = stored(active(interactions, max_interactions))
    return similarities_of(rows, rows, min_jaccard)


def similarities_of(some: DataFrame, interactions: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """The same for pairs of an item of ``some`` interactions and any other; those of two such items are there twice unless all are."""
    def counted(rows: DataFrame) -> DataFrame:
        # Of items that users share: an item is what has a vector here.
        rows = rows.filter("item_id IS NOT NULL").groupBy(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"))
        return rows.agg(F.count(F.lit(1)).cast("double").alias("value"))

    every = stored(counted(interactions))
    found = sharing(every if some is interactions else counted(some), every, min_jaccard)
    first = F.col("user_id") > F.col("other_id")
    sides = [F.when(first, F.col(a)).otherwise(F.col(b)) for a, b in (("user_id", "other_id"), ("other_id", "user_id"), ("own", "theirs"), ("theirs", "own"))]
    names = ("item_a", "item_b", "occ_a", "occ_b")
    rows = found.select("user_id", "other_id", F.col("shared").cast("long").alias("n_cooc"), "jaccard", *(x.cast("long").alias(n) for x, n in zip(sides, names, strict=True)))
    if some is interactions:
        rows = rows.filter("user_id > other_id")
    return rows.select("item_a", "item_b", "n_cooc", "occ_a", "occ_b", "jaccard")


def with_jaccard(pairs: DataFrame, counts: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    occ_a = counts.select(F.col("item_id").alias("item_a"), F.col("n").alias("occ_a"))
    occ_b = counts.select(F.col("item_id").alias("item_b"), F.col("n").alias("occ_b"))
    joined = pairs.join(occ_a, "item_a").join(occ_b, "item_b")
    jaccard = F.col("n_cooc").cast("double") / (F.col("occ_a") + F.col("occ_b") - F.col("n_cooc"))
    return joined.withColumn("jaccard", jaccard).filter(F.col("jaccard") > min_jaccard).select("item_a", "item_b", "n_cooc", "occ_a", "occ_b", "jaccard")
