"""Next items for sessions from recent similar sessions.

``history`` has ``session_id, item_id, ord``, ``evolving`` has ``session_id, item_id, position`` with positions from 1.
Every ranking is on integers with a unique tie-break, so that results don't depend on the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.decays import match_decay_tenths
from palimpsest.functions.fixed import fixed


@dataclass(frozen=True)
class SessionParams:
    """m: sessions kept for an item, and matches kept for a session; k: neighbours."""

    k: int = 100
    m: int = 500
    served: int = 20


def recency(history: DataFrame) -> DataFrame:
    return history.groupBy("session_id").agg(F.max("ord").alias("max_ord"))


def item_sessions(history: DataFrame) -> DataFrame:
    """``item_id, session_id, max_ord``: each item's sessions, with the latest click of the session."""
    latest = F.max("ord").over(W.partitionBy("session_id"))
    return history.select("session_id", "item_id", latest.alias("max_ord")).distinct()


def index(pairs: DataFrame, m: int) -> DataFrame:
    """The m most recent sessions of each item. Serves both ways: by item to match, by session to score."""
    order = W.partitionBy("item_id").orderBy(F.desc("max_ord"), "session_id")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= m).drop("_r").select("item_id", "session_id", "max_ord")


def idf(pairs: DataFrame, n_total: int | DataFrame) -> DataFrame:
    """``item_id, idf``: log of ``n_total`` over the item's sessions, all of them. ``n_total`` is a number or a row with ``n``."""
    counts = pairs.groupBy("item_id").agg(F.countDistinct("session_id").alias("n_sessions"))
    if isinstance(n_total, DataFrame):
        return counts.crossJoin(n_total.select(F.col("n").alias("_n"))).select("item_id", F.log(F.col("_n") / F.col("n_sessions")).alias("idf"))
    return counts.select("item_id", F.log(F.lit(float(n_total)) / F.col("n_sessions")).alias("idf"))


def click_weights(evolving: DataFrame) -> DataFrame:
    """``session_id, item_id, w``: the sum of an item's positions."""
    return evolving.groupBy("session_id", "item_id").agg(F.sum("position").cast("bigint").alias("w"))


def lengths(evolving: DataFrame) -> DataFrame:
    return evolving.groupBy("session_id").agg(F.countDistinct("item_id").alias("length"))


def _shared(item_index: DataFrame, evolving: DataFrame) -> DataFrame:
    """A row for each evolving session, historical session and item of both."""
    weighted = click_weights(evolving).withColumn("length", F.count(F.lit(1)).over(W.partitionBy("session_id")))
    hist = item_index.select("item_id", F.col("session_id").alias("hist_id"), "max_ord")
    return weighted.join(hist, "item_id")


def matches(item_index: DataFrame, evolving: DataFrame, m: int) -> DataFrame:
    """``session_id, hist_id, max_ord, sum_w, length, match_position``: the m most recent sessions that share an item.

    One join and one aggregate: the items that two sessions share are just the index's rows that match, so the sum of
    weights and the match position come with the match. A repeated item weighs the sum of its positions, and one whose
    weight passes the length counts as the first position.
    """
    place = F.when(F.col("length") - F.col("w") + 1 > 0, F.col("length") - F.col("w") + 1).otherwise(1)
    pairs = _shared(item_index, evolving).groupBy("session_id", "hist_id").agg(
        F.max("max_ord").alias("max_ord"), F.sum("w").alias("sum_w"), F.max("length").alias("length"), F.min(place).alias("match_position")
    )
    order = W.partitionBy("session_id").orderBy(F.desc("max_ord"), "hist_id")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= m).drop("_r")


def with_similarity(matched: DataFrame) -> DataFrame:
    return matched.withColumn("similarity", F.col("sum_w").cast("double") / F.col("length"))


def neighbours(matched: DataFrame, k: int) -> DataFrame:
    """The k most similar matches. All of a session's similarities have one denominator, so the numerators rank them."""
    order = W.partitionBy("session_id").orderBy(F.desc("sum_w"), "hist_id")
    return with_similarity(matched.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r"))


def item_scores(near: DataFrame, item_index: DataFrame, weights: DataFrame) -> DataFrame:
    """``session_id, item_id, score``: decayed similarities of the neighbours that have an item, times its idf."""
    items = item_index.select(F.col("session_id").alias("hist_id"), "item_id")
    part = match_decay_tenths(F.col("match_position")) * F.col("sum_w")
    raw = near.join(items, "hist_id").groupBy("session_id", "item_id").agg(F.sum(part).alias("tenths"), F.max("length").alias("length"))
    score = F.col("tenths").cast("double") / (10 * F.col("length")) * F.col("idf")
    return raw.join(weights, "item_id").select("session_id", "item_id", score.alias("score"))


def model(history: DataFrame, evolving: DataFrame, params: SessionParams, n_total: int | DataFrame) -> DataFrame:
    """Scores of all items for all evolving sessions. ``n_total`` is by default the number of clicks, by the user's choice."""
    pairs = item_sessions(history)
    item_index = index(pairs, params.m)
    near = neighbours(matches(item_index, evolving, params.m), params.k)
    return item_scores(near, item_index, idf(pairs, n_total))


def current_items(evolving: DataFrame) -> DataFrame:
    """The item of each session's last click."""
    return evolving.groupBy("session_id").agg(F.max_by("item_id", "position").alias("current"))


def serve(scores: DataFrame, evolving: DataFrame, n: int = 20, digits: int = 9) -> DataFrame:
    """``session_id, recommended``: the n items of highest score but for the current one; ties to the smaller item.

    A session without any gets an empty list.
    """
    now = current_items(evolving)
    left = scores.join(now, "session_id").filter("item_id <> current")
    order = W.partitionBy("session_id").orderBy(F.desc("_s"), "item_id")
    top = left.withColumn("_s", fixed(F.col("score"), digits)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    listed = top.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "item_id"))), lambda x: x["item_id"]).alias("recommended"))
    return now.select("session_id").join(listed, "session_id", "left").select("session_id", F.coalesce("recommended", F.array().cast("array<bigint>")).alias("recommended"))


def prefixes(evolving: DataFrame) -> DataFrame:
    """Each session once for each of its proper prefixes, under the id ``<session>:<length>``.

    So a replay of sessions click by click is one run of the model.
    """
    counted = evolving.withColumn("n", F.max("position").over(W.partitionBy("session_id")))
    long = counted.filter("n > position").withColumn("prefix", F.explode(F.sequence(F.col("position"), F.col("n") - 1)))
    return long.select(F.concat_ws(":", "session_id", "prefix").alias("session_id"), "item_id", "position")


def replay(history: DataFrame, evolving: DataFrame, params: SessionParams, n_total: int | DataFrame) -> DataFrame:
    """``session_id, prefix, recommended, observed`` for each proper prefix of each evolving session."""
    parts = prefixes(evolving)
    served = serve(model(history, parts, params, n_total), parts, params.served)
    clicks = evolving.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"]).alias("_clicks"))
    pieces = F.split("session_id", ":")
    keyed = served.select(F.element_at(pieces, 1).cast("bigint").alias("session_id"), F.element_at(pieces, 2).cast("int").alias("prefix"), "recommended")
    joined = keyed.join(clicks, "session_id")
    return joined.select("session_id", "prefix", "recommended", F.slice("_clicks", F.col("prefix") + 1, F.size("_clicks")).alias("observed"))


def sampled_prefixes(evolving: DataFrame, sessions: int, seed: int = 42) -> DataFrame:
    """A seeded choice of sessions, each cut to a seeded shorter length of one click at least."""
    whole = evolving.groupBy("session_id").agg(F.max("position").alias("n")).filter("n > 1")
    lot = F.xxhash64("session_id", F.lit(seed))
    chosen = whole.orderBy(lot, "session_id").limit(sessions)
    cut = (F.pmod(F.xxhash64("session_id", F.lit(seed + 1)), F.col("n") - 1) + 1).cast("int")
    return evolving.join(chosen.select("session_id", cut.alias("cut")), "session_id").filter("position <= cut").drop("cut")
