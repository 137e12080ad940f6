"""Measurement protocols, serving, and streams that update, on small data."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import baskets as bm
from palimpsest.operators import retrain_sessions as rs
from palimpsest.operators import sessions as sm
from palimpsest.operators.baskets import BasketParams
from palimpsest.operators.retrain_sessions import RefitParams
from palimpsest.operators.sessions import SessionParams
from palimpsest.plans import changes as C
from palimpsest.plans import incremental as inc
from palimpsest.plans import workloads as w
from palimpsest.sources import readers, writers
from palimpsest.streaming.snapshots import Snapshots, follow, recommendation_step, session_step

PARAMS, SHOP = SessionParams(k=2, m=3), BasketParams(group_size=2, k=2)


def close(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def clicks(spark):
    made = random.Random(1)
    rows = sorted({(made.randrange(20), made.randrange(8), made.randrange(1000)) for _ in range(80)})
    history = spark.createDataFrame(rows, "session_id long, item_id long, ord long")
    evolving = spark.createDataFrame([(s, made.randrange(8), p + 1) for s in range(100, 104) for p in range(4)], "session_id long, item_id long, position int")
    return history, evolving


@pytest.fixture(scope="module")
def baskets(spark):
    made = random.Random(2)
    return spark.createDataFrame([(u, n + 1, sorted(made.sample(range(12), 3))) for u in range(8) for n in range(made.randrange(2, 5))], "user_id long, basket_no int, items array<long>")


@pytest.mark.parametrize("kind,batch", [("deletion", 2), ("insertion", 2), ("mixed", 3)])
def test_click_changes(clicks, kind, batch):
    rows = list(w.click_changes(kind, *clicks, PARAMS, clicks=4, batch=batch, sessions=3, seed=42, steps=2))
    assert len(rows) == 2 and all(r["experiment"] == kind and r["latency"] > 0 and 0 <= r["changes"] <= 3 for r in rows)
    with pytest.raises(ValueError):
        next(w.click_changes("other", *clicks, PARAMS, 4, 2, 3, 42))


@pytest.mark.parametrize("kind,batch", [("deletion", 2), ("insertion", 2), ("mixed", 3)])
def test_basket_changes(baskets, kind, batch):
    rows = list(w.basket_changes(kind, baskets, SHOP, changed=4, batch=batch, users=5, seed=42, steps=2))
    assert len(rows) == 2 and all(r["experiment"] == kind and r["latency"] > 0 and 0 <= r["updates"] <= 5 for r in rows)


def test_batches_of_sessions(clicks):
    rows = list(w.batched_sessions(*clicks, PARAMS, sessions=2, deletions=1, lengths=range(1, 4)))
    assert [(r["batch"], r["session_length"]) for r in rows] == [(b, n) for b in (0, 1) for n in (1, 2, 3)]


def test_replay_forgetting_and_refits(spark, clicks, baskets, tmp_path):
    rows = list(w.prefix_replay(*clicks, PARAMS, lengths=(1, 2)))
    assert [r["position"] for r in rows] == [1, 2]
    writers.write_measurements(spark, rows, str(tmp_path / "m"))
    interactions = baskets.select("user_id", F.explode("items").alias("item_id")).distinct()
    assert [r["step"] for r in w.forgotten_users(interactions, 2)] == ["train", "forget"]
    assert [r["deletion"] for r in w.session_refits(*clicks, 3, 2, RefitParams(k=2))] == [1, 2]
    assert [r["deletion"] for r in w.basket_refits(baskets, 3, 2, k=2, groups=2)] == [1, 2]


def test_serving_keeps_what_was_clicked(spark, clicks):
    history, _ = clicks
    serving = rs.Serving(history, RefitParams(k=3, sample_size=0))
    assert serving.click(7000, 1, skip=True) is None
    evolving = spark.createDataFrame([(7000, 1, 1), (7000, 2, 2)], "session_id long, item_id long, position int")
    assert close(serving.click(7000, 2)) == close(rs.scores(history, evolving, RefitParams(k=3, sample_size=0)))
    serving.finish(7000, now=5000)
    assert serving.history.filter("session_id = 7000 AND ord = 5000").count() == 2 and not serving.clicks
    found = rs.sessions_of_items(serving.history, spark.createDataFrame([(2,)], "item_id long"))
    assert 7000 in {r.session_id for r in found.collect()}
    assert {r.item_id for r in rs.items_of_sessions(serving.history, spark.createDataFrame([(7000,)], "session_id long")).collect()} == {1, 2}


def test_baskets_in_codes(spark):
    rows = spark.createDataFrame([(1, 3, 9), (1, 3, 9), (1, 5, 7), (2, 1, 8)], "user_id long, basket_no int, item_id long")
    codes = spark.createDataFrame([(9, 0), (7, 1)], "item_id long, code long")
    assert [(r.user_id, r.basket_no, r["items"]) for r in readers.encoded_baskets(rows, codes).orderBy("basket_no").collect()] == [(1, 1, [0]), (1, 2, [1])]


def test_a_stream_of_clicks_updates(spark, clicks, tmp_path):
    history, evolving = clicks
    snaps = Snapshots(spark, str(tmp_path / "snapshots"))
    snaps.write(0, **vars(inc.SessionState.build(history, evolving, PARAMS, 80)))
    gone, more = history.limit(2).collect(), [(3, 7, 2000), (99, 1, 2001)]
    changes = C.deletions(spark.createDataFrame(gone, history.schema)).unionByName(C.insertions(spark.createDataFrame(more, history.schema)))
    changes.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, item_id long, ord long, diff int").json(str(tmp_path / "in"))
    follow(stream, snaps, session_step(PARAMS, 80), str(tmp_path / "checkpoint")).awaitTermination()
    want = sm.model(C.apply(history, changes), evolving, PARAMS, 80)
    assert close(snaps.read("result")) == close(want)
    old = sm.model(history, evolving, PARAMS, 80)
    assert sorted(r["diff"] for r in snaps.read("delta").collect()) == sorted(r["diff"] for r in C.delta(old, snaps.read("result")).collect())


def test_a_stream_of_baskets_updates(spark, baskets, tmp_path):
    everyone = lambda rows: rows.select("user_id").distinct()
    snaps = Snapshots(spark, str(tmp_path / "snapshots"))
    snaps.write(0, **vars(inc.BasketState.build(baskets, everyone(baskets), SHOP)))
    gone, more = baskets.filter("user_id IN (1, 2) AND basket_no = 1"), spark.createDataFrame([(3, 9, [1, 2])], baskets.schema)
    writers.write_basket_events(gone, str(tmp_path / "in"), deletion=True)
    writers.write_basket_events(more.union(more), str(tmp_path / "in"))
    stream = readers.basket_events(spark, str(tmp_path / "in"))
    follow(stream, snaps, recommendation_step(everyone, SHOP), str(tmp_path / "checkpoint")).awaitTermination()
    after = C.add_baskets(C.delete_baskets(baskets, gone), more)
    assert close(snaps.read("result")) == close(bm.recommend(after, everyone(baskets), SHOP))
