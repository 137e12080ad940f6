"""Measurement protocols: how long a model takes to follow changes, against computing it again, and how many keys change.

Each gives rows of one kind, which ``writers.write_measurements`` puts into a file. Latencies are in microseconds, from a
batch of changes to the new results of all keys that it reaches; ``settling`` is the time to write the new state after that,
so that plans don't grow. The grids of the full protocols are fixed values; a caller scales them to its data.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.held import held
from palimpsest.operators import items as im
from palimpsest.operators import retrain_baskets as rb
from palimpsest.operators import retrain_sessions as rs
from palimpsest.operators import sessions as sm
from palimpsest.operators.baskets import BasketParams
from palimpsest.operators.retrain_sessions import RefitParams
from palimpsest.operators.sessions import SessionParams
from palimpsest.plans import changes as C
from palimpsest.plans import incremental as inc

#: The grids of the full protocols.
SEEDS = (42, 767, 999)
BATCHES = (1, 10, 100)
ACTIVE_SESSIONS = (100, 1000, 10_000)
QUERY_USERS = (10, 100, 1000)
CLICKS_CHANGED, BASKETS_CHANGED = 10_000, 1000
MIXED_STEPS = {"sessions": 1000, "baskets": 100}
PREFIX_LENGTHS, DELETING_AT = range(1, 10), (3, 7)


def timed(df: DataFrame) -> int:
    """Microseconds to compute all rows of a frame."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round((time.perf_counter() - began) * 1e6)


def _since(began: float) -> int:
    return round((time.perf_counter() - began) * 1e6)


def _answered(result: DataFrame, affected: DataFrame, began: float) -> int:
    """Microseconds until the new results of affected keys are there."""
    held(result.join(affected, affected.columns, "left_semi"))
    return _since(began)


def _settled(state):
    began = time.perf_counter()
    return state.saved(), _since(began)


def _lot(seed: int, *key: str):
    return F.xxhash64(*key, F.lit(seed))


def active(evolving: DataFrame, sessions: int, seed: int) -> DataFrame:
    """Clicks of a seeded choice of evolving sessions."""
    chosen = evolving.select("session_id").distinct().orderBy(_lot(seed, "session_id"), "session_id").limit(sessions)
    return evolving.join(chosen, "session_id", "left_semi").select(*evolving.columns)


def _dealt(rows: DataFrame, batch: int, order: list) -> DataFrame:
    """Rows, few as they are, with the number of their batch."""
    return held(rows.withColumn("_batch", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / batch)))


def click_changes(kind: str, history: DataFrame, evolving: DataFrame, params: SessionParams, clicks: int, batch: int, sessions: int, seed: int, steps: int | None = None) -> Iterator[dict]:
    """``deletion`` forgets a seeded choice of clicks, ``insertion`` starts without the latest and adds them, ``mixed`` adds nine
    and forgets one a step; each in batches, on one state that is saved after each.
    """
    evolving = active(evolving, sessions, seed)
    total = history.count()
    mine = history.columns
    latest = [F.desc("ord"), "session_id", "item_id"]
    by_lot = [_lot(seed, *mine), *mine]
    if kind == "deletion":
        changes = _dealt(C.deletions(history.orderBy(*by_lot).limit(clicks)), batch, by_lot)
    elif kind == "insertion":
        new = held(history.orderBy(*latest).limit(clicks))
        history = C.apply(history, C.deletions(new))
        changes = _dealt(C.insertions(new), batch, ["ord", "session_id", "item_id"])
    elif kind == "mixed":
        n = (steps or MIXED_STEPS["sessions"]) * (batch - 1)
        new = held(history.orderBy(*latest).limit(n))
        history = C.apply(history, C.deletions(new))
        old = history.orderBy(*by_lot).limit(-(-n // (batch - 1)))
        changes = _dealt(C.insertions(new), batch - 1, ["ord", "session_id", "item_id"]).unionByName(_dealt(C.deletions(old), 1, by_lot))
        changes = held(changes)
    else:
        raise ValueError(f"changes are a deletion, an insertion or mixed, not {kind}")
    state = inc.SessionState.build(history, evolving, params, total).saved()
    for number in range(-(-clicks // batch) if steps is None else steps):
        part = held(changes.filter(F.col("_batch") == number).drop("_batch"))
        if part.isEmpty():
            break
        began = time.perf_counter()
        state, affected = inc.update_session_state(state, part, params, total)
        latency, reached = _answered(state.result, affected, began), affected.count()
        state, settling = _settled(state)
        yield {"model": "vs", "experiment": kind, "seed": seed, "batch": batch, "active": sessions, "latency": latency, "changes": reached, "settling": settling}


def basket_changes(kind: str, baskets: DataFrame, params: BasketParams, changed: int, batch: int, users: int, seed: int, steps: int | None = None) -> Iterator[dict]:
    """The same of the basket model: ``deletion`` of a seeded choice of baskets, ``insertion`` of the last ones, or ``mixed``."""
    queries = held(baskets.select("user_id").distinct().orderBy(_lot(seed, "user_id"), "user_id").limit(users))
    by_lot = [_lot(seed, "user_id", "basket_no"), "user_id", "basket_no"]
    last = baskets.withColumn("_last", F.max("basket_no").over(W.partitionBy("user_id"))).filter("basket_no = _last AND basket_no > 1").drop("_last")
    n = changed if kind != "mixed" else (steps or MIXED_STEPS["baskets"]) * (batch - 1)
    more = gone = None
    if kind in ("insertion", "mixed"):
        new = held(last.orderBy(*by_lot).limit(n))
        baskets = C.delete_baskets(baskets, new)
        more = _dealt(new, batch if kind == "insertion" else batch - 1, by_lot)
    if kind in ("deletion", "mixed"):
        # One basket a user, so that no deletion renumbers what another one names.
        firsts = baskets.withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy(*by_lot))).filter("_r = 1").drop("_r")
        gone = _dealt(firsts.orderBy(*by_lot).limit(n if kind == "deletion" else -(-n // (batch - 1))), batch if kind == "deletion" else 1, by_lot)
    if gone is None and more is None:
        raise ValueError(f"changes are a deletion, an insertion or mixed, not {kind}")
    state = inc.BasketState.build(baskets, queries, params).saved()
    for number in range(-(-changed // batch) if steps is None else steps):
        part = [x and held(x.filter(F.col("_batch") == number).drop("_batch")) for x in (gone, more)]
        if all(x is None or x.isEmpty() for x in part):
            break
        began = time.perf_counter()
        state, affected = inc.update_basket_state(state, queries, params, *part)
        latency, updates = _answered(state.result, affected, began), affected.count()
        state, settling = _settled(state)
        yield {"model": "tifu", "experiment": kind, "queries": users, "seed": seed, "batch": batch, "latency": latency, "updates": updates, "settling": settling}


def batched_sessions(history: DataFrame, evolving: DataFrame, params: SessionParams, sessions: int, deletions: int, seed: int = 42, lengths=PREFIX_LENGTHS) -> Iterator[dict]:
    """Batches of evolving sessions grow click by click; at lengths 3 and 7 whole sessions are deleted from the history."""
    total = history.count()
    ids = held(evolving.select("session_id").distinct().withColumn("batch", F.floor((F.row_number().over(W.orderBy("session_id")) - 1) / sessions)))
    for batch in [r.batch for r in ids.select("batch").distinct().orderBy("batch").collect()]:
        mine = held(evolving.join(ids.filter(F.col("batch") == batch), "session_id", "left_semi").select(*evolving.columns))
        state = inc.SessionState.build(history, mine.filter(F.col("position") < min(lengths)), params, total).saved()
        for length in lengths:
            clicks = held(C.insertions(mine.filter(F.col("position") == length)))
            gone = history.limit(0)
            if length in DELETING_AT:
                chosen = state.history.select("session_id").distinct().orderBy(_lot(seed + length, "session_id"), "session_id").limit(deletions)
                gone = state.history.join(held(chosen), "session_id", "left_semi").select(*history.columns)
            began = time.perf_counter()
            state, affected = inc.update_session_state(state, held(C.deletions(gone)), params, total, clicks)
            latency = _answered(state.result, affected, began)
            state, _ = _settled(state)
            yield {"batch": int(batch), "session_length": length, "latency_in_micros": latency}


def prefix_replay(history: DataFrame, evolving: DataFrame, params: SessionParams, lengths=PREFIX_LENGTHS) -> Iterator[dict]:
    """Time to serve all sessions at each length."""
    total = history.count()
    for length in lengths:
        part = evolving.filter(F.col("position") <= length)
        yield {"position": length, "latency_in_micros": timed(sm.serve(sm.model(history, part, params, total), part, params.served))}


def forgotten_users(interactions: DataFrame, users: int, seed: int = 42) -> Iterator[dict]:
    """Item similarities trained, and updated after a seeded choice of users is forgotten, against computing them again."""
    chosen = interactions.select("user_id").distinct().orderBy(_lot(seed, "user_id"), "user_id").limit(users)
    gone = held(C.forget_users(interactions, chosen))
    yield {"model": "itembased", "step": "train", "latency": timed(im.similarities(interactions))}
    state = inc.ItemState.build(interactions).saved()
    began = time.perf_counter()
    state, items = inc.update_item_state(state, gone)
    held(state.result.join(items.withColumnRenamed("item_id", "item_a"), "item_a", "left_semi"))
    yield {"model": "itembased", "step": "forget", "latency": _since(began)}


def refits(model: Callable[[DataFrame], DataFrame], rows: DataFrame, key: str, n: int, seed: int = 42) -> Iterator[dict]:
    """Time to fit again from scratch after each of ``n`` deletions of all rows of a key."""
    chosen = [r[0] for r in rows.select(key).distinct().orderBy(_lot(seed, key), key).limit(n).collect()]
    for number in range(len(chosen)):
        yield {"deletion": number + 1, "latency": timed(model(rows.filter(~F.col(key).isin(chosen[: number + 1]))))}


def session_refits(history: DataFrame, evolving: DataFrame, queries: int, deletions: int = 20, params: RefitParams = RefitParams(), seed: int = 42) -> Iterator[dict]:
    asked = active(evolving, queries, seed)
    for row in refits(lambda h: rs.scores(h, asked, params), history, "session_id", deletions, seed):
        yield {"model": "vs-refit", "queries": queries, **row}


def basket_refits(baskets: DataFrame, queries: int, deletions: int = 100, k: int = 300, alpha: float = 0.7, groups: int = 7, within: float = 0.9, between: float = 0.7, seed: int = 42) -> Iterator[dict]:
    asked = held(baskets.select("user_id").distinct().orderBy(_lot(seed, "user_id"), "user_id").limit(queries))
    for row in refits(lambda b: fitted_baskets(b, asked, k, alpha, groups, within, between), baskets, "user_id", deletions, seed):
        yield {"model": "tifu-refit", "queries": queries, **row}


def fitted_baskets(baskets: DataFrame, asked: DataFrame, k: int, alpha: float, groups: int, within: float, between: float) -> DataFrame:
    """Train and predict in one: histories in groups, Euclidean neighbours, merged vectors of the users asked for."""
    vectors = rb.grouped_history(baskets, groups, within, between)
    mine = vectors.join(asked, "user_id", "left_semi")
    return rb.merge_history(mine, vectors, rb.euclidean_neighbours(mine, vectors, k), alpha)
