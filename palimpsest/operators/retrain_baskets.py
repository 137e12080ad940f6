"""The basket model as it is when refitted from scratch: other groups, Euclidean neighbours, and merging of futures.

Histories are baskets ``user_id, basket_no, items`` numbered from 1; vectors are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.held import ranked, stored
from palimpsest.functions.packed import nearest, with_neighbours
from palimpsest.functions.similarity import softmax
from palimpsest.operators.baskets import added, scaled


def _distinct_items(baskets: DataFrame) -> DataFrame:
    whole = W.partitionBy("user_id")
    rows = baskets.withColumn("n", F.max("basket_no").over(whole))
    return rows.select("user_id", "basket_no", "n", F.explode(F.array_distinct("items")).alias("item_id"))


def mean_history(baskets: DataFrame) -> DataFrame:
    """``user_id, item_id, value``: in what share of the baskets an item is."""
    return _distinct_items(baskets).groupBy("user_id", "item_id").agg((F.count(F.lit(1)).cast("double") / F.max("n")).alias("value"))


def decayed_history(baskets: DataFrame, rate: float) -> DataFrame:
    """The same with each basket weighed by its distance from the last one."""
    rows = _distinct_items(baskets)
    return rows.groupBy("user_id", "item_id").agg((F.sum(F.pow(F.lit(rate), F.col("n") - F.col("basket_no"))) / F.max("n")).alias("value"))


def grouped_history(baskets: DataFrame, groups: int, within: float, between: float) -> DataFrame:
    """Decayed baskets in ``groups`` groups of nearly equal size, the larger ones last; groups decay too.

    With fewer baskets than groups each is a group by itself, and decays as the first ones would.
    """
    small = F.floor(F.col("n") / groups)
    first = (groups - F.col("n") % groups) * small
    number = F.when(F.col("n") < groups, F.col("basket_no")).when(
        F.col("basket_no") <= first, F.ceil(F.col("basket_no") / small)
    ).otherwise(groups - F.col("n") % groups + F.ceil((F.col("basket_no") - first) / (small + 1)))
    size = F.when(F.col("n") < groups, 1).when(F.col("basket_no") <= first, small).otherwise(small + 1)
    real = F.least(F.col("n"), F.lit(groups))
    weight = F.pow(F.lit(within), F.col("n") - F.col("basket_no")) / size * F.pow(F.lit(between), groups - number) / real
    rows = _distinct_items(baskets).filter("n > 0")
    return rows.groupBy("user_id", "item_id").agg(F.sum(weight).alias("value"))


def euclidean_neighbours(queries: DataFrame, training: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """``user_id, other_id, distance``: the k nearest training vectors of each query vector, itself included if it is there.

    Pairs are made inside tasks (see ``packed``). Values aren't negative, so whoever shares no item with a query is no nearer
    than anyone of less norm: of these, the k of least norm are enough.
    """
    return nearest(queries, training, k, "distance", digits)


def future_vectors(future: DataFrame, step: int = 1) -> DataFrame:
    """``user_id, item_id, value``: 1 for each item of a user's future basket of this number."""
    return future.filter(F.col("basket_no") == step).select("user_id", F.explode(F.array_distinct("items")).alias("item_id"), F.lit(1.0).alias("value"))


def weighted_futures(near: DataFrame, future: DataFrame, step: int = 1) -> DataFrame:
    """Neighbours' future items, weighed by the softmax of inverse distances; a distance of 0, to six digits, counts as an inverse of 0."""
    inverse = F.when(F.round("distance", 6) == 0, 0.0).otherwise(1 / F.col("distance"))
    weight = softmax(inverse, W.partitionBy("user_id"))
    weighed = near.withColumn("_w", F.when(weight == 0, 1.0).otherwise(weight))
    theirs = weighed.join(future_vectors(future, step).select(F.col("user_id").alias("other_id"), "item_id"), "other_id")
    return theirs.groupBy("user_id", "item_id").agg(F.sum("_w").alias("value"))


def most_frequent(near: DataFrame, future: DataFrame, step: int = 1) -> DataFrame:
    """How many neighbours have an item in their future basket."""
    theirs = near.join(future_vectors(future, step).select(F.col("user_id").alias("other_id"), "item_id"), "other_id")
    return theirs.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("value"))


def merge_history(queries: DataFrame, training: DataFrame, near: DataFrame, alpha: float) -> DataFrame:
    return with_neighbours(queries, training, near, alpha, 1 - alpha)


def merge_history_and_future(queries: DataFrame, training: DataFrame, near: DataFrame, future: DataFrame, alpha: float, beta: float) -> DataFrame:
    theirs = added(scaled(training, beta * (1 - alpha)), scaled(future_vectors(future), 1 - beta))
    return with_neighbours(queries, stored(theirs), near, alpha * beta, 1.0)


def own_elements(vectors: DataFrame) -> DataFrame:
    """The user's own vector as the prediction."""
    return vectors.select("user_id", "item_id", "value")


def split(history: DataFrame, future: DataFrame | None = None, train: float = 0.8, validate: float = 0.0, least: int = 2, least_future: int = 1) -> DataFrame:
    """``user_id, part``: users with enough baskets, in the order of ids, as train, validation and test.

    ``validate`` is the share of the training part that validates.
    """
    users = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("user_id")
    if future is not None:
        enough = future.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_future)
        users = users.join(enough.select("user_id"), "user_id", "left_semi")
    total = users.agg(F.count(F.lit(1)).alias("total"))
    placed = ranked(users, "user_id", "_rank").crossJoin(total).withColumn("place", F.col("_rank") + 1)
    to_train, to_fit = F.floor(F.col("total") * train), F.floor(F.col("total") * train * (1 - validate))
    part = F.when(F.col("place") <= to_fit, "train").when(F.col("place") <= to_train, "validation").otherwise("test")
    return placed.select("user_id", part.alias("part"))
