"""Neighbours and sums whose pairs stay inside tasks, against all pairs made by hand; many parts and blocks too."""

import math
import random

import pytest
from compare import duck_rows, rows

from palimpsest.functions import packed
from palimpsest.operators import baskets as bm
from palimpsest.plans import incremental
from palimpsest.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _vectors(n_users=40, n_items=25, seed=5):
    draw = random.Random(seed)
    return {u * 3 - 20: {i: draw.choice([0.25, 0.5, 1.5, 2.0]) for i in draw.sample(range(n_items), draw.randint(1, 6))} for u in range(n_users)}


def _frame(spark, vectors):
    return spark.createDataFrame([(u, i, x) for u, v in vectors.items() for i, x in v.items()], "user_id long, item_id long, value double")


@pytest.fixture(params=[False, True])
def sizes(request, monkeypatch):
    if request.param:
        for name, value in (("QUERY_ENTRIES", 16), ("BLOCK_ENTRIES", 20), ("SUM_ENTRIES", 60), ("WHOLE", 2)):
            monkeypatch.setattr(packed, name, value)


def test_neighbours_by_jaccard(spark, sizes):
    vectors = _vectors()
    want = set()
    for u, v in vectors.items():
        near = [(len(v.keys() & w.keys()) / len(v.keys() | w.keys()), -o) for o, w in vectors.items() if o != u and v.keys() & w.keys()]
        want |= {(u, -o, j) for j, o in sorted(near, reverse=True)[:4]}
    rows = _frame(spark, vectors)
    found = bm.exact_neighbours(rows, rows, 4)
    assert {tuple(r) for r in packed.nearest(rows, rows.select("user_id", "item_id"), 4, "jaccard").collect()} == want
    assert {tuple(r) for r in found.select("user_id", "other_id", "jaccard").collect()} == want
    assert "Join" not in packed.nearest(rows, rows, 4, "jaccard")._jdf.queryExecution().executedPlan().toString() or packed.WHOLE == 2


def test_neighbours_by_distance(spark, sizes):
    vectors = _vectors()
    want = set()
    for u, v in vectors.items():
        far = [(math.floor(math.dist([v.get(i, 0) for i in range(25)], [w.get(i, 0) for i in range(25)]) * 1e9 + 0.3), o) for o, w in vectors.items()]
        want |= {(u, o) for _, o in sorted(far)[:7]}
    rows = _frame(spark, vectors)
    assert {(r.user_id, r.other_id) for r in packed.nearest(rows, rows, 7, "distance").collect()} == want


def test_sums_over_neighbours(spark, sizes):
    vectors = _vectors()
    near = {u: [o for o in vectors if (o + u) % 5 == 0 and o != u] for u in vectors if u % 2}
    want = {}
    for u, others in near.items():
        for i in set(vectors[u]).union(*(vectors[o] for o in others)) if others else ():
            want[u, i] = 0.7 * vectors[u].get(i, 0) + 0.3 * sum(vectors[o].get(i, 0) for o in others) / len(others)
    rows, pairs = _frame(spark, vectors), spark.createDataFrame([(u, o) for u, x in near.items() for o in x], "user_id long, other_id long")
    found = bm.merged(rows, pairs, 0.7)
    assert {(r.user_id, r.item_id): r.value for r in found.collect()} == pytest.approx(want)
    top = packed.with_neighbours(None, rows, pairs, 0.7, 1 - 0.7, 3)
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in bm.top_items(found, 3).collect()}


@pytest.mark.parametrize("ranges, dense", [(1 << 20, 1 << 18), (9, 0), (30, 1 << 18)])
def test_recommended_by_ranges(spark, monkeypatch, ranges, dense):
    monkeypatch.setattr(packed, "QUERY_ENTRIES", ranges)
    monkeypatch.setattr(packed, "DENSE", dense)
    monkeypatch.setattr(packed, "RANGE_COPIES", 10_000)
    vectors = _vectors()
    rows = _frame(spark, vectors).unionByName(spark.createDataFrame([(-20, None, 1.5), (-17, None, 2.0), (999, None, 1.0)], "user_id long, item_id long, value double"))
    some = rows.filter("user_id % 4 <> 0").select("user_id").distinct()
    near = bm.exact_neighbours(rows, some, 4)
    want = {n: {tuple(r) for r in packed.with_neighbours(None, rows, near, 0.7, 1 - 0.7, n).collect()} for n in (3, 50)}
    for n, expected in want.items():
        assert {tuple(r) for r in packed.recommended(rows, some, 4, 0.7, 1 - 0.7, n).collect()} == expected
    empty = rows.filter("user_id > 10000")
    assert packed.recommended(empty, empty, 4, 0.7, 1 - 0.7, 3).collect() == []


@pytest.mark.parametrize("name, value", [("RANGE_ENTRIES", 40), ("RANGE_COPIES", 0.1)])
def test_ranges_that_share_too_much(spark, monkeypatch, name, value):
    monkeypatch.setattr(packed, "QUERY_ENTRIES", 20)
    monkeypatch.setattr(packed, "RANGE_COPIES", 10_000)
    monkeypatch.setattr(packed, name, value)
    rows = _frame(spark, _vectors())
    assert packed.recommended(rows, rows, 4, 0.7, 1 - 0.7, 3) is None


@pytest.mark.parametrize("name", ["metrics_ndcg_all", "metrics_ndcg_full_all", "metrics_prf_all", "metrics_summary_20_all"])
def test_metrics_write_no_neighbours(spark, monkeypatch, name):
    monkeypatch.setattr(bm, "exact_neighbours", None)
    assert rows(QUERIES[name](spark, SF)) == duck_rows(SQL[name], SF)


@pytest.mark.parametrize("held", [3 << 22, 400])
def test_recommended_whatever_the_order_of_ids(spark, monkeypatch, held):
    for name, value in (("QUERY_ENTRIES", 20), ("RANGE_ENTRIES", 40), ("HELD_ENTRIES", held), ("PAIRS", 64)):
        monkeypatch.setattr(packed, name, value)
    vectors = _vectors()
    rows = _frame(spark, vectors).unionByName(spark.createDataFrame([(-20, None, 1.5), (-17, None, 2.0), (999, None, 1.0)], "user_id long, item_id long, value double"))
    some = rows.filter("user_id % 4 <> 0").select("user_id").distinct()
    near = bm.exact_neighbours(rows, some, 4)
    assert packed.recommended(rows, some, 4, 0.7, 1 - 0.7, 3) is None
    for n in (3, 50):
        found = packed.recommended_anyhow(rows, some, 4, 0.7, 1 - 0.7, n)
        assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, packed.with_neighbours(None, rows, near, 0.7, 1 - 0.7, n).collect()), key=repr)
    monkeypatch.setattr(packed, "STREAMS", 2)
    assert packed.recommended_anyhow(rows, some, 4, 0.7, 1 - 0.7, 3) is None


@pytest.mark.parametrize("name", ["metrics_ndcg_full_all", "metrics_prf_all", "metrics_summary_20_all"])
def test_metrics_write_no_neighbours_where_ranges_share_too_much(spark, monkeypatch, name):
    monkeypatch.setattr(packed, "QUERY_ENTRIES", 2000)
    monkeypatch.setattr(packed, "RANGE_ENTRIES", 2500)
    monkeypatch.setattr(bm, "exact_neighbours", None)
    assert rows(QUERIES[name](spark, SF)) == duck_rows(SQL[name], SF)


@pytest.mark.parametrize("name", ["ib_forget_users", "tifu_add_baskets", "tifu_changed_users_all"])
def test_updates_that_reach_many(spark, monkeypatch, name):
    monkeypatch.setattr(incremental, "FEW", 0)
    monkeypatch.setattr(incremental.items_model, "cooccurrences", None)  # no pairs by a join
    monkeypatch.setattr(incremental.baskets_model, "overlaps", None)
    want = duck_rows(SQL[name], SF)
    assert rows(QUERIES[name](spark, SF)) == want
