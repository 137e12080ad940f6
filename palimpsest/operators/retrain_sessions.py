"""The session model as it is when refitted from scratch, with all its options.

It differs from ``sessions`` on purpose: a repeated item counts with its last position, idf is over clicks and optional,
nothing is cut before matching, and the decay is by the distance of the first match from the latest click.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.decays import POSITION_WEIGHTS, SCORE_DECAYS, day_decay
from palimpsest.functions.fixed import fixed


@dataclass(frozen=True)
class RefitParams:
    k: int = 100
    sample_size: int = 1000
    sampling: str = "recent"
    weighting: str | None = "div"
    weighting_score: str = "div"
    remind: bool = True
    normalize: bool = True
    idf_weighting: float = 0.0
    idf_weighting_session: bool = False
    weighting_time: bool = False
    dwelling_time: bool = False
    last_n_clicks: int | None = None
    seed: int = 42


def without_outliers(clicks: DataFrame, quantile: float = 0.995) -> DataFrame:
    """Clicks of sessions with fewer clicks than the exact quantile of session sizes."""
    sizes = clicks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    limit = sizes.agg(F.percentile("n", F.lit(quantile)).alias("limit"))
    keep = sizes.crossJoin(limit).filter("n < limit").select("session_id")
    return clicks.join(keep, "session_id", "left_semi")


def last_days(clicks: DataFrame, days: int) -> DataFrame:
    """Clicks since the midnight that is ``days`` days before the day of the last click."""
    since = clicks.agg(((F.floor(F.max("ord") / 86400) - days) * 86400).alias("since"))
    return clicks.crossJoin(since).filter("ord >= since").drop("since")


def idf(clicks: DataFrame) -> DataFrame:
    """``item_id, idf``: log of the number of sessions over the item's clicks."""
    sessions = clicks.agg(F.countDistinct("session_id").alias("n_sessions"))
    return clicks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(sessions).select("item_id", F.log(F.col("n_sessions") / F.col("n")).alias("idf"))


def item_popularity(clicks: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``item_id, popularity``: in how many of the sessions an item is, over the largest such number."""
    pairs = clicks.select("session_id", "item_id").distinct()
    if sessions is not None:
        pairs = pairs.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.max("n").alias("most"))).select("item_id", (F.col("n").cast("double") / F.col("most")).alias("popularity"))


def position_weights(evolving: DataFrame, params: RefitParams, weights: DataFrame | None = None) -> DataFrame:
    """``session_id, item_id, weight, position, back, n_distinct``: of each distinct item, by its last click.

    ``back`` is 1 for the latest click. With ``dwelling_time``, ``evolving`` has ``ord``, and a weight is multiplied by the
    time until the next click over the longest such time; the last click counts whole.
    """
    whole = W.partitionBy("session_id")
    rows = evolving
    if params.last_n_clicks is not None:
        rows = rows.withColumn("_back", F.max("position").over(whole) - F.col("position")).filter(F.col("_back") < params.last_n_clicks)
        rows = rows.withColumn("position", F.row_number().over(whole.orderBy("position"))).drop("_back")
    n = F.max("position").over(whole)
    weight = POSITION_WEIGHTS[params.weighting](F.col("position"), n) if params.weighting else F.lit(1.0)
    rows = rows.withColumn("weight", weight).withColumn("back", n - F.col("position") + 1)
    if params.dwelling_time:
        stay = F.lead("ord").over(whole.orderBy("position")) - F.col("ord")
        rows = rows.withColumn("_stay", stay).withColumn("_most", F.max("_stay").over(whole))
        share = F.when(F.col("_stay").isNull(), 1.0).when(F.col("_most") > 0, F.col("_stay") / F.col("_most")).otherwise(0.0)
        rows = rows.withColumn("weight", F.col("weight") * share)
    last = rows.withColumn("_r", F.row_number().over(W.partitionBy("session_id", "item_id").orderBy(F.desc("position")))).filter("_r = 1")
    if params.idf_weighting_session and weights is not None:
        last = last.join(weights, "item_id", "left").withColumn("weight", F.coalesce("idf", F.lit(0.0))).drop("idf")
    return last.select("session_id", "item_id", "weight", "position", "back", F.count(F.lit(1)).over(whole).alias("n_distinct"))


def neighbours(history: DataFrame, evolving: DataFrame, params: RefitParams, now: int | None = None) -> DataFrame:
    """``session_id, hist_id, similarity, step``: the k most similar of the sampled sessions; step is back to the first match."""
    weights = idf(history) if params.idf_weighting_session else None
    mine = position_weights(evolving, params, weights)
    items = history.select(F.col("session_id").alias("hist_id"), "item_id", F.max("ord").over(W.partitionBy("session_id")).alias("last")).distinct()
    pairs = mine.join(items, "item_id").groupBy("session_id", "hist_id").agg(
        F.sum("weight").alias("dot"), F.max("n_distinct").alias("n_distinct"), F.min("back").alias("step"), F.max("last").alias("last")
    )
    if params.sample_size:
        lots = {"recent": F.desc("last"), "random": F.xxhash64("hist_id", F.lit(params.seed)), "slice": F.col("hist_id")}
        if params.sampling not in lots:
            raise ValueError(f"sampling is one of {', '.join(lots)}, not {params.sampling}")
        lot = lots[params.sampling]
        pairs = pairs.withColumn("_r", F.row_number().over(W.partitionBy("session_id").orderBy(lot, "hist_id"))).filter(F.col("_r") <= params.sample_size)
    similarity = F.col("dot") / F.col("n_distinct")
    if params.weighting_time:
        if now is None:
            raise ValueError("weighting by time needs the time of now")
        similarity = similarity * day_decay(F.round((F.lit(now) - F.col("last")) / 86400))
    pairs = pairs.withColumn("similarity", similarity).filter("similarity > 0")
    order = W.partitionBy("session_id").orderBy(F.desc(fixed(F.col("similarity"), 9)), "hist_id")
    return pairs.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= params.k).select("session_id", "hist_id", "similarity", "step")


def scores(history: DataFrame, evolving: DataFrame, params: RefitParams, now: int | None = None) -> DataFrame:
    """``session_id, item_id, score`` after normalising, without the current item."""
    near = neighbours(history, evolving, params, now).withColumn("part", F.col("similarity") * SCORE_DECAYS[params.weighting_score](F.col("step")))
    items = history.select(F.col("session_id").alias("hist_id"), "item_id").distinct()
    rows = near.join(items, "hist_id")
    if params.idf_weighting:
        rows = rows.join(idf(history), "item_id").withColumn("part", F.col("part") * (1 + F.col("idf") * params.idf_weighting))
    if not params.remind:
        rows = rows.join(evolving.select("session_id", "item_id").distinct(), ["session_id", "item_id"], "left_anti")
    summed = rows.groupBy("session_id", "item_id").agg(F.sum("part").alias("score"))
    current = evolving.groupBy("session_id").agg(F.max_by("item_id", "position").alias("_current"))
    summed = summed.join(current, "session_id").filter("item_id <> _current").drop("_current")
    if params.normalize:
        most = F.max("score").over(W.partitionBy("session_id"))
        summed = summed.withColumn("score", F.when(most != 0, F.col("score") / most).otherwise(F.lit(0.0)))
    return summed


def items_of_sessions(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, item_id``: distinct items of the sessions asked for."""
    return history.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "item_id").distinct()


def sessions_of_items(history: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, session_id``: distinct sessions of the items asked for."""
    return history.join(items.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "session_id").distinct()


class Serving:
    """Sessions that come in click by click. What was clicked so far is kept, and each answer is that of all clicks so far."""

    def __init__(self, history: DataFrame, params: RefitParams = RefitParams()):
        self.history, self.params = history, params
        self.clicks: dict[int, list[int]] = {}

    def click(self, session_id: int, item_id: int, skip: bool = False) -> DataFrame | None:
        """``session_id, item_id, score`` after one more click; with ``skip`` it is only taken in."""
        seen = self.clicks.setdefault(session_id, [])
        seen.append(item_id)
        if skip:
            return None
        rows = [(session_id, item, place + 1) for place, item in enumerate(seen)]
        evolving = self.history.sparkSession.createDataFrame(rows, "session_id long, item_id long, position int")
        return scores(self.history, evolving, self.params)

    def finish(self, session_id: int, now: int) -> None:
        """Put a finished session into the history, at the time of now."""
        rows = [(session_id, item) for item in self.clicks.pop(session_id, [])]
        if rows:
            self.history = extended(self.history, self.history.sparkSession.createDataFrame(rows, "session_id long, item_id long"), now)


def extended(history: DataFrame, finished: DataFrame, now: int) -> DataFrame:
    """History with finished sessions in it, all at the time of now."""
    return history.select("session_id", "item_id", "ord").unionByName(finished.select("session_id", "item_id", F.lit(now).cast("bigint").alias("ord")))
