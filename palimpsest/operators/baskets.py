"""Next baskets from time-decayed user vectors and the vectors of similar users.

Baskets have ``user_id, basket_no, items`` with numbers from 1 without gaps. Vectors are long: ``user_id, item_id, value``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.fixed import fixed
from palimpsest.functions.held import stored
from palimpsest.functions.lsh import Family, bands, best_bands
from palimpsest.functions.packed import nearest, recommended_anyhow, with_neighbours


@dataclass(frozen=True)
class BasketParams:
    group_size: int = 7
    r_basket: float = 0.9
    r_group: float = 0.7
    k: int = 300
    alpha: float = 0.7
    permutations: int = 1280
    jaccard_threshold: float = 0.1
    seed: int = 42


#: Parameters by the kind of shop.
PRESETS = {
    "valuedshopper": BasketParams(7, 1.0, 0.6, 300, 0.7, 1280, 0.2),
    "instacart": BasketParams(3, 0.9, 0.7, 900, 0.9, 1280, 0.1),
    "tafang": BasketParams(7, 0.9, 0.7, 300, 0.7, 1280, 0.1),
}
#: Fixed point of discretised values.
SCALE = 10**15


def renumbered(baskets: DataFrame) -> DataFrame:
    """Baskets numbered from 1 in their order, without gaps."""
    number = F.row_number().over(W.partitionBy("user_id").orderBy("basket_no"))
    return baskets.select("user_id", number.alias("basket_no"), "items")


def group_vectors(baskets: DataFrame, params: BasketParams) -> DataFrame:
    """``user_id, grp, item_id, value``: decayed means over groups of successive baskets; a short group counts as the end of one."""
    size = params.group_size
    group = F.ceil(F.col("basket_no") / size).cast("int")
    counted = baskets.withColumn("grp", group).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("user_id", "grp")))
    place = F.pmod(F.col("basket_no") - 1, F.lit(size)) + 1 + size - F.col("n")
    weight = F.pow(F.lit(params.r_basket), size - place) / F.col("n")
    rows = counted.select("user_id", "grp", weight.alias("_w"), F.explode("items").alias("item_id"))
    return rows.groupBy("user_id", "grp", "item_id").agg(F.sum("_w").alias("value"))


def user_vectors(baskets: DataFrame, params: BasketParams) -> DataFrame:
    """``user_id, item_id, value``: decayed means of a user's group vectors."""
    return _of_groups(group_vectors(baskets, params), baskets, params)


def _of_groups(groups: DataFrame, baskets: DataFrame, params: BasketParams) -> DataFrame:
    last = baskets.groupBy("user_id").agg(F.ceil(F.max("basket_no") / params.group_size).cast("int").alias("_g"))
    weight = F.pow(F.lit(params.r_group), F.col("_g") - F.col("grp")) / F.col("_g")
    return groups.join(last, "user_id").groupBy("user_id", "item_id").agg(F.sum(weight * F.col("value")).alias("value"))


def discretised(vectors: DataFrame) -> DataFrame:
    """Values cut to fixed point, as whole numbers."""
    return vectors.withColumn("value", F.floor(F.col("value") * SCALE).cast("bigint"))


def scaled(vectors: DataFrame, factor: float) -> DataFrame:
    return vectors.withColumn("value", F.col("value") * factor)


def added(*vectors: DataFrame) -> DataFrame:
    both = vectors[0]
    for v in vectors[1:]:
        both = both.unionByName(v)
    return both.groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))


def overlaps(sets: DataFrame, queries: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``user_id, other_id, jaccard`` of item sets ``user_id, item_id``, for query users and others that share an item.

    Query users are cut down before the join. ``candidates`` (``user_id, other_id``) restricts the pairs.
    """
    if candidates is not None:
        return _overlaps_of(sets, queries, candidates)
    sizes = sets.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    mine = sets.join(queries.select("user_id").distinct(), "user_id", "left_semi")
    pairs = mine.join(sets.select(F.col("user_id").alias("other_id"), "item_id"), "item_id").filter("user_id <> other_id")
    counted = pairs.groupBy("user_id", "other_id").agg(F.count(F.lit(1)).alias("both"))
    a = sizes.select("user_id", F.col("size").alias("_a"))
    b = sizes.select(F.col("user_id").alias("other_id"), F.col("size").alias("_b"))
    joined = counted.join(a, "user_id").join(b, "other_id")
    return joined.select("user_id", "other_id", (F.col("both").cast("double") / (F.col("_a") + F.col("_b") - F.col("both"))).alias("jaccard"))


def _overlaps_of(sets: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The same for pairs that are given: each meets the item sets of both, and no list of who has an item is opened."""
    lists = sets.groupBy("user_id").agg(F.collect_set("item_id").alias("items"))
    pairs = candidates.select("user_id", "other_id").distinct().join(queries.select("user_id").distinct(), "user_id", "left_semi")
    own, theirs = lists.withColumnRenamed("items", "_own"), lists.select(F.col("user_id").alias("other_id"), F.col("items").alias("_theirs"))
    both = F.size(F.array_intersect("_own", "_theirs"))
    rows = pairs.filter("user_id <> other_id").join(own, "user_id").join(theirs, "other_id").withColumn("_both", both).filter("_both > 0")
    return rows.select("user_id", "other_id", (F.col("_both").cast("double") / (F.size("_own") + F.size("_theirs") - F.col("_both"))).alias("jaccard"))


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("jaccard"), "other_id")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def signatures(sets: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """``user_id, signature`` of the item sets."""
    items = sets.groupBy("user_id").agg(F.collect_set("item_id").alias("items"))
    return items.select("user_id", Family(permutations, seed).signature(F.col("items")).alias("signature"))


def buckets(signed: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """``user_id, band, rows``."""
    return signed.select("user_id", F.inline(bands(F.col("signature"), n_bands, rows)))


def lsh_candidates(sets: DataFrame, queries: DataFrame, permutations: int, n_bands: int, rows: int, seed: int = 42) -> DataFrame:
    """``user_id, other_id``: query users and the others that they share a bucket with."""
    placed = buckets(signatures(sets, permutations, seed), n_bands, rows)
    mine = placed.join(queries.select("user_id").distinct(), "user_id", "left_semi")
    others = placed.select(F.col("user_id").alias("other_id"), "band", "rows")
    return mine.join(others, ["band", "rows"]).filter("user_id <> other_id").select("user_id", "other_id").distinct()


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``user_id, other_id, jaccard``: the k users of most similar item sets of each query user, among all who share an item.

    Pairs are made inside tasks (see ``packed``): all users against all would otherwise be written out.
    """
    sets = vectors.select("user_id", "item_id")
    return nearest(sets.join(queries.select("user_id").distinct(), "user_id", "left_semi"), sets, k, "jaccard")


def merged(vectors: DataFrame, near: DataFrame, alpha: float) -> DataFrame:
    """alpha times the user's vector and the rest times the mean of the neighbours'; a user without neighbours has no row."""
    return with_neighbours(None, vectors, near, alpha, 1 - alpha)


def truncated(vectors: DataFrame) -> DataFrame:
    """Values cut to fixed point."""
    return discretised(vectors).withColumn("value", F.col("value").cast("double") / SCALE)


def discrete_user_vectors(baskets: DataFrame, params: BasketParams) -> DataFrame:
    """User vectors with values cut to fixed point in each group and again at the end, as sums by whole numbers keep them."""
    groups = truncated(group_vectors(baskets, params))
    return truncated(_of_groups(groups, baskets, params))


def recommend(baskets: DataFrame, queries: DataFrame, params: BasketParams, candidates: str = "exact", discrete: bool = False) -> DataFrame:
    """``user_id, item_id, value`` for query users. Candidates are all users that share an item, or those of the LSH buckets.

    With ``discrete``, vectors of groups and users and the result are cut to fixed point.
    """
    vectors, near = _with_neighbours(baskets, queries, params, candidates, discrete)
    out = merged(vectors, near, params.alpha)
    return truncated(out) if discrete else out


def recommend_top(baskets: DataFrame, queries: DataFrame, params: BasketParams, n: int) -> DataFrame:
    """What ``top_items`` makes of ``recommend``, cut where it is summed: no more than n rows of a user leave a task."""
    vectors = stored(user_vectors(baskets, params))
    found = recommended_anyhow(vectors, queries, params.k, params.alpha, 1 - params.alpha, n)
    if found is not None:
        return found
    near = stored(exact_neighbours(vectors, queries, params.k))
    return with_neighbours(None, vectors, near, params.alpha, 1 - params.alpha, n)


def _with_neighbours(baskets: DataFrame, queries: DataFrame, params: BasketParams, candidates: str = "exact", discrete: bool = False) -> tuple[DataFrame, DataFrame]:
    """User vectors and the neighbours of query users, both in the shared folder."""
    vectors = stored(discrete_user_vectors(baskets, params) if discrete else user_vectors(baskets, params))
    if candidates != "lsh":
        return vectors, stored(exact_neighbours(vectors, queries, params.k))
    sets = vectors.select("user_id", "item_id")
    n_bands, rows = best_bands(params.jaccard_threshold, params.permutations)
    found = lsh_candidates(sets, queries, params.permutations, n_bands, rows, params.seed)
    return vectors, stored(neighbours(overlaps(sets, queries, found), params.k))


def top_items(vectors: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """``user_id, item_id, rank`` of the n highest values; ties to the smaller item."""
    order = W.partitionBy("user_id").orderBy(F.desc(fixed(F.col("value"), digits)), "item_id")
    return vectors.select("user_id", "item_id", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= n)
