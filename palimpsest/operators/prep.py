"""Datasets of baskets: statistics, multi-hot vectors, pruning, and codes of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.held import ranked


def stats(baskets: DataFrame) -> DataFrame:
    """One row: users, items, baskets, and baskets of a user on average."""
    items = baskets.select(F.explode("items").alias("item_id")).agg(F.countDistinct("item_id").alias("n_items"))
    row = baskets.agg(F.countDistinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_baskets"))
    return row.crossJoin(items).select("n_users", "n_items", "n_baskets", (F.col("n_baskets").cast("double") / F.col("n_users")).alias("baskets_per_user"))


def multi_hot(baskets: DataFrame) -> DataFrame:
    """``user_id, basket_no, item_id, value``: 1 for each distinct item of a basket."""
    return baskets.select("user_id", "basket_no", F.explode(F.array_distinct("items")).alias("item_id"), F.lit(1).alias("value"))


def prune(baskets: DataFrame, min_items: int = 2, min_baskets: int = 2) -> DataFrame:
    """Baskets of enough items, of users with enough of these."""
    large = baskets.filter(F.size("items") >= min_items)
    return large.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("user_id"))).filter(F.col("_n") >= min_baskets).drop("_n")


def item_codes(items: DataFrame) -> DataFrame:
    """``item_id, code``: codes from 0 in the order of ids."""
    return ranked(items.select("item_id").distinct(), "item_id", "code")


def first_seen_codes(interactions: DataFrame, seq: str = "seq") -> DataFrame:
    """``item_id, code``: codes from 0 in the order in which items are first seen; ``seq`` numbers the rows, without repeats."""
    first = interactions.groupBy("item_id").agg(F.min(seq).alias("_first"))
    return ranked(first, "_first", "code").select("item_id", "code")
