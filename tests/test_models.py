"""Small cases with results worked out by hand or independently, and updates against full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.lsh import Family, best_bands
from palimpsest.operators import baskets as bm
from palimpsest.operators import items as im
from palimpsest.operators import metrics as mm
from palimpsest.operators import prep
from palimpsest.operators import retrain_baskets as rb
from palimpsest.operators import retrain_sessions as rs
from palimpsest.operators import sessions as sm
from palimpsest.operators.baskets import PRESETS, BasketParams
from palimpsest.operators.retrain_sessions import RefitParams
from palimpsest.operators.sessions import SessionParams
from palimpsest.plans import changes as C
from palimpsest.plans import incremental as inc

HISTORY = [(1, 10, 1), (1, 20, 2), (2, 20, 3), (2, 30, 4), (3, 10, 5), (3, 30, 6)]
TWO = SessionParams(k=2, m=2)


def history(spark, rows):
    return spark.createDataFrame(rows, "session_id long, item_id long, ord long")


def evolving(spark, items, session=100):
    return spark.createDataFrame([(session, x, i + 1) for i, x in enumerate(items)], "session_id long, item_id long, position int")


def interactions(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long")


def baskets(spark, rows):
    return spark.createDataFrame(rows, "user_id long, basket_no int, items array<long>")


def found(df, *key, value="score", digits=6):
    return {(tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]): round(r[value], digits) for r in df.collect()}


def test_item_similarity(spark):
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1)]
    got = found(im.similarities(interactions(spark, rows)), "item_a", "item_b", value="jaccard")
    assert got == {(2, 1): round(2 / 3, 6), (3, 1): round(1 / 3, 6), (3, 2): 0.5}
    base = interactions(spark, rows)
    after = inc.update_items(base, im.similarities(base), C.forget_users(base, base.filter("user_id = 2")))
    assert found(after.result, "item_a", "item_b", value="jaccard") == {(2, 1): 0.5}


def test_repeated_interactions_multiply(spark):
    rows = interactions(spark, [(1, 1)] * 2 + [(1, 2)] * 3)
    assert [tuple(r) for r in im.cooccurrences(rows).collect()] == [(2, 1, 6)]
    assert im.active(rows, 5).count() == 0


def test_session_scores(spark):
    h, e = history(spark, HISTORY), evolving(spark, [10, 20])
    pairs = sm.item_sessions(h)
    index = sm.index(pairs, 2)
    kept = {(r.item_id, r.session_id) for r in index.collect()}
    assert kept == {(10, 3), (10, 1), (20, 2), (20, 1), (30, 3), (30, 2)}
    near = {r.hist_id: (r.similarity, r.match_position) for r in sm.neighbours(sm.matches(index, e, 2), 2).collect()}
    assert near == {2: (1.0, 1), 3: (0.5, 2)}
    scores = sm.model(h, e, TWO, 6)
    assert found(scores, "item_id") == {10: 0.439445, 20: 0.988751, 30: 1.428196}
    assert sm.serve(scores, e).first().recommended == [30, 10]


def test_forgotten_click_and_repeated_click(spark):
    h, e = history(spark, HISTORY), evolving(spark, [10, 20])
    gone = C.deletions(history(spark, [(3, 30, 6)]))
    update = inc.update_sessions(h, e, sm.model(h, e, TWO, 6), gone, TWO, 6)
    assert found(update.result, "item_id") == {10: 0.439445, 20: 0.988751, 30: 1.612584}
    assert C.changed_keys(C.delta(sm.model(h, e, TWO, 6), update.result), "session_id").count() == 1
    again = sm.model(h, evolving(spark, [10, 20, 10]), TWO, 6)
    assert found(again, "item_id") == {10: 1.977502, 20: 0.988751, 30: 2.966253}


def test_a_session_without_matches_is_served_nothing(spark):
    h, e = history(spark, HISTORY), evolving(spark, [99])
    assert sm.serve(sm.model(h, e, TWO, 6), e).first().recommended == []


def test_replay_is_the_model_on_prefixes(spark):
    h, e = history(spark, HISTORY), evolving(spark, [10, 20, 30])
    got = {r.prefix: (r.recommended, r.observed) for r in sm.replay(h, e, TWO, 6).collect()}
    for n in (1, 2):
        part = evolving(spark, [10, 20, 30][:n])
        assert got[n] == (sm.serve(sm.model(h, part, TWO, 6), part).first().recommended, [10, 20, 30][n:])


def test_sampled_prefixes_are_seeded(spark):
    e = evolving(spark, range(5)).union(evolving(spark, range(3), 7)).union(evolving(spark, [1], 8))
    got = sm.sampled_prefixes(e, 2).collect()
    assert got == sm.sampled_prefixes(e, 2).collect()
    assert {r.session_id for r in got} == {100, 7}
    assert all(r.position < (5 if r.session_id == 100 else 3) for r in got)


P2 = BasketParams(group_size=2, r_basket=0.9, r_group=0.7, k=1, alpha=0.7)
WORKED = [[0, 1, 2], [1, 2, 3], [0, 1, 3], [2, 3], [0, 1, 2, 3]]
STATES = [[1, 1, 1, 0], [0.45, 0.95, 0.95, 0.5], [0.6575, 0.8325, 0.3325, 0.675], [0.3825, 0.5575, 0.5825, 0.65], [0.5118, 0.5935, 0.6052, 0.6367]]


def vector(df, n=4):
    got = {r.item_id: r.value for r in df.collect()}
    return [round(got.get(i, 0), 4) for i in range(n)]


def test_user_vectors(spark):
    for n in range(1, 6):
        rows = baskets(spark, [(1, i + 1, b) for i, b in enumerate(WORKED[:n])])
        assert vector(bm.user_vectors(rows, P2)) == pytest.approx(STATES[n - 1], abs=6e-5)
    all_five = baskets(spark, [(1, i + 1, b) for i, b in enumerate(WORKED)])
    after = C.delete_baskets(all_five, all_five.filter("basket_no = 2"))
    assert vector(bm.user_vectors(after, P2)) == [0.5825, 0.5825, 0.6325, 0.65]
    with pytest.raises(C.AbsentRows):
        C.delete_baskets(all_five, spark.createDataFrame([(1, 9)], "user_id long, basket_no int"))


def test_recommendation(spark):
    vectors = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5)], "user_id long, item_id long, value double")
    near = spark.createDataFrame([(1, 2)], "user_id long, other_id long")
    assert found(bm.merged(vectors, near, 0.7), "user_id", "item_id", value="value") == {(1, 0): 0.85, (1, 1): 0.15}


def test_presets():
    assert PRESETS["instacart"] == BasketParams(3, 0.9, 0.7, 900, 0.9, 1280, 0.1, 42)


def test_bands_and_signatures(spark):
    assert best_bands(0.1, 1280) == (426, 3)
    assert best_bands(0.2, 1280) == (320, 4)
    assert best_bands(0.1, 128) == (64, 2)
    assert best_bands(0.2, 128) == (28, 2)
    row = spark.createDataFrame([([1, 5, 9],)], "items array<long>").select(Family(8).signature(F.col("items")).alias("s")).first()
    assert row.s == [min((a * x + b) % (2**31 - 1) for x in (1, 5, 9)) for a, b in Family(8).coefficients()]


def test_lsh_finds_similar_users(spark):
    made = random.Random(3)
    rows, pairs = [], []
    for u in range(0, 60, 2):
        items = made.sample(range(1000), 20)
        rows += [(u, i) for i in items] + [(u + 1, i) for i in items[:15]]
        pairs.append((u, u + 1))
    sets = interactions(spark, rows)
    got = {(r.user_id, r.other_id) for r in bm.lsh_candidates(sets, sets, 128, 32, 4).collect()}
    assert sum(p in got for p in pairs) / len(pairs) > 0.9
    assert all(a != b for a, b in got)


def test_lsh_recommendations_are_exact_where_candidates_are(spark):
    rows = baskets(spark, [(1, 1, [1, 2, 3]), (2, 1, [1, 2, 3]), (3, 1, [1, 2, 3, 4])])
    exact, lsh = (bm.recommend(rows, rows, BasketParams(k=5, permutations=128, jaccard_threshold=0.1), c) for c in ("exact", "lsh"))
    assert found(exact, "user_id", "item_id", value="value") == found(lsh, "user_id", "item_id", value="value")


def test_metrics(spark):
    predictions = spark.createDataFrame([(1, 1, 1), (1, 4, 2), (1, 2, 3)], "user_id long, item_id long, rank int")
    truth = interactions(spark, [(1, 1), (1, 2), (1, 3)])
    assert found(mm.ndcg(predictions, truth, 3), "user_id", value="ndcg") == {1: 0.703918}
    row = mm.precision_recall(predictions, truth, 3).first()
    assert (round(row.precision, 6), round(row.recall, 6), round(row.f1, 6)) == (0.666667,) * 3
    assert mm.hit(predictions, truth, 3).first().hit == 1
    full = mm.ndcg(predictions, interactions(spark, [(1, i) for i in range(1, 6)]), 2, "full").first().ndcg
    assert full == pytest.approx((1.0 + 1 / 2**0 * 0 + (1 / 1.584962500721156)) / sum(1 / __import__("math").log2(i + 1) for i in range(1, 6)), abs=1e-6)
    assert mm.summary(predictions, truth, 3).first().hit_ratio == 1.0


def model_rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_session_updates_equal_recomputation(spark, seed):
    made = random.Random(seed)
    rows = sorted({(made.randrange(12), made.randrange(8), made.randrange(1000)) for _ in range(60)})
    h = history(spark, rows)
    e = evolving(spark, [made.randrange(8) for _ in range(3)], 100).union(evolving(spark, [made.randrange(8) for _ in range(2)], 101))
    more = [(made.randrange(15), made.randrange(9), 2000 + i) for i in range(3)]
    changes = C.deletions(history(spark, made.sample(rows, 5))).unionByName(C.insertions(history(spark, more)))
    params = SessionParams(k=2, m=3)
    update = inc.update_sessions(h, e, sm.model(h, e, params, 60), changes, params, 60)
    assert model_rows(update.result) == model_rows(sm.model(C.apply(h, changes), e, params, 60))


@pytest.mark.parametrize("seed", range(2))
def test_item_updates_equal_recomputation(spark, seed):
    made = random.Random(seed)
    rows = sorted({(made.randrange(10), made.randrange(12)) for _ in range(50)})
    base = interactions(spark, rows)
    changes = C.deletions(interactions(spark, made.sample(rows, 6))).unionByName(C.insertions(interactions(spark, [(3, 20), (11, 1), (11, 2)])))
    update = inc.update_items(base, im.similarities(base, 7, 0.1), changes, 7, 0.1)
    assert model_rows(update.result) == model_rows(im.similarities(C.apply(base, changes), 7, 0.1))


@pytest.mark.parametrize("seed", range(2))
def test_basket_updates_equal_recomputation(spark, seed):
    made = random.Random(seed)
    rows = [(u, n + 1, sorted(made.sample(range(15), 3))) for u in range(8) for n in range(made.randrange(1, 5))]
    base, queries = baskets(spark, rows), interactions(spark, [(u, 0) for u in range(0, 8, 2)])
    params = BasketParams(group_size=2, k=2)
    gone = base.filter("user_id IN (1, 2) AND basket_no = 1")
    more = baskets(spark, [(5, 1, [1, 2]), (9, 1, [3, 4])])
    after = C.add_baskets(C.delete_baskets(base, gone), more)
    update = inc.update_baskets(base, queries, params, gone, more)
    assert model_rows(update.result) == model_rows(bm.recommend(after, queries, params))
    assert model_rows(update.base.select("user_id", "basket_no")) == model_rows(after.select("user_id", "basket_no"))
    # One step after another, from what was saved, is as good as both at once.
    state = inc.BasketState.build(base, queries, params).saved()
    first, _ = inc.update_basket_state(state, queries, params, gone=gone)
    second, _ = inc.update_basket_state(first.saved(), queries, params, more=more)
    assert model_rows(second.result) == model_rows(update.result)


def test_changes(spark):
    base = interactions(spark, [(1, 1), (1, 1), (2, 5)])
    after = C.apply(base, C.deletions(interactions(spark, [(1, 1)])).unionByName(C.insertions(interactions(spark, [(3, 3)]))))
    assert model_rows(after) == [(1, 1), (2, 5), (3, 3)]
    with pytest.raises(C.AbsentRows):
        C.apply(base, C.deletions(interactions(spark, [(9, 9)])))
    assert model_rows(C.delta(base, after)) == [(1, 1, -1), (3, 3, 1)]


def test_refit_options(spark):
    h, e = history(spark, HISTORY), evolving(spark, [10, 20])
    got = found(rs.scores(h, e, RefitParams(k=2, sample_size=0, weighting="div", weighting_score="div", normalize=False)), "item_id")
    # Session 1 shares both items (1/2 + 1) / 2, session 2 the last 1 / 2, session 3 the first (1/2) / 2.
    assert got == {10: 0.75, 30: 0.5}
    fresh = rs.scores(h, e, RefitParams(k=3, sample_size=0, remind=False))
    assert {r.item_id for r in fresh.collect()} == {30}
    old = rs.neighbours(h, e, RefitParams(k=3, weighting_time=True), now=86400 * 10)
    assert old.count() == 3
    timed = e.withColumn("ord", F.col("position") * 10)
    assert rs.position_weights(timed, RefitParams(dwelling_time=True, weighting="same")).agg(F.sum("weight")).first()[0] == 2.0
    assert rs.position_weights(e, RefitParams(last_n_clicks=1)).count() == 1
    assert rs.extended(h, e, 50).count() == 8
    weighed = rs.scores(h, e, RefitParams(k=3, idf_weighting=1.0, idf_weighting_session=True))
    assert weighed.count() == 2
    assert rs.neighbours(h, e, RefitParams(k=1, sample_size=1, sampling="random")).count() == 1


def test_basket_refits(spark):
    rows = baskets(spark, [(1, n + 1, [n]) for n in range(5)] + [(2, 1, [0, 1])])
    assert found(rb.mean_history(rows), "user_id", "item_id", value="value")[(1, 0)] == 0.2
    assert found(rb.decayed_history(rows, 0.5), "user_id", "item_id", value="value")[(1, 3)] == 0.1
    # Five baskets in two groups: two, then three.
    got = found(rb.grouped_history(rows, 2, 1.0, 0.5), "user_id", "item_id", value="value")
    assert got[(1, 0)] == round(1 / 2 * 0.5 / 2, 6) and got[(1, 4)] == round(1 / 3 / 2, 6) and got[(2, 0)] == 0.5
    vectors = rb.mean_history(rows)
    near = rb.euclidean_neighbours(vectors, vectors, 2)
    assert {(r.user_id, r.other_id) for r in near.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    future = baskets(spark, [(1, 1, [7]), (2, 1, [8])])
    assert found(rb.most_frequent(near, future), "user_id", "item_id", value="value")[(1, 8)] == 1.0
    assert rb.weighted_futures(near, future).count() == 4
    assert rb.own_elements(vectors).count() == vectors.count()
    split = rb.split(rows, least=1)
    assert {(r.user_id, r.part) for r in split.collect()} == {(1, "train"), (2, "test")}


def test_distant_users_are_neighbours_by_norm(spark):
    vectors = spark.createDataFrame([(1, 1, 1.0), (2, 2, 0.5), (3, 3, 0.1), (4, 1, 5.0)], "user_id long, item_id long, value double")
    near = rb.euclidean_neighbours(vectors.filter("user_id = 1"), vectors, 3).collect()
    assert [r.other_id for r in sorted(near, key=lambda r: r.distance)] == [1, 3, 2]


def test_bands_are_the_best_of_all():
    grid = [0.01 * (i + 0.5) for i in range(100)]

    def error(threshold, bands, rows):
        return sum((1 - s**rows) ** bands if s >= threshold else 1 - (1 - s**rows) ** bands for s in grid)

    for threshold, n in ((0.1, 128), (0.8, 128), (0.9, 256), (0.95, 256)):
        found = best_bands(threshold, n, 0.01)
        least = min(error(threshold, b, r) for r in range(1, n + 1) for b in range(1, n // r + 1))
        assert error(threshold, *found) == pytest.approx(least, abs=1e-6)
    bands, rows = best_bands(0.95, 1280)
    assert rows > 32 and bands * rows <= 1280


def test_given_candidates_have_the_overlaps_of_all(spark):
    made = random.Random(2)
    sets = interactions(spark, sorted({(made.randrange(12), made.randrange(9)) for _ in range(60)}))
    users = sets.select("user_id").distinct()
    every = bm.overlaps(sets, users)
    pairs = users.crossJoin(users.withColumnRenamed("user_id", "other_id"))
    assert model_rows(bm.overlaps(sets, users, pairs)) == model_rows(every)


def test_measures_in_one_pass_are_those_of_each(spark):
    made = random.Random(3)
    predictions = spark.createDataFrame([(u, i, r + 1) for u in range(6) for r, i in enumerate(made.sample(range(9), 5))], "user_id long, item_id long, rank int")
    truth = interactions(spark, [(u, made.randrange(9)) for u in range(5) for _ in range(3)])
    for ideal in ("truncated", "full"):
        rows = mm.by_user(predictions, truth, 3, ideal).filter("n_true IS NOT NULL")
        assert model_rows(rows.select("user_id", "ndcg")) == model_rows(mm.ndcg(predictions, truth, 3, ideal))
        assert model_rows(rows.select("user_id", "precision", "recall", "f1")) == model_rows(mm.precision_recall(predictions, truth, 3).drop("n_correct"))
        assert model_rows(rows.select("user_id", "hit")) == model_rows(mm.hit(predictions, truth, 3))


def test_codes(spark):
    rows = spark.createDataFrame([(3, 7), (1, 9), (2, 7), (4, 1), (5, 9)], "seq long, item_id long")
    assert model_rows(prep.item_codes(rows)) == [(1, 0), (7, 1), (9, 2)]
    assert model_rows(prep.first_seen_codes(rows)) == [(1, 2), (7, 1), (9, 0)]


def test_discrete_vectors(spark):
    rows = baskets(spark, [(1, n + 1, [n % 3, 5]) for n in range(5)] + [(2, 1, [0, 5])])
    params = BasketParams(group_size=2, k=1)
    exact, cut = (found(v, "user_id", "item_id", value="value") for v in (bm.user_vectors(rows, params), bm.discrete_user_vectors(rows, params)))
    assert exact.keys() == cut.keys() and all(abs(exact[x] - cut[x]) < 1e-6 for x in exact)
    users = interactions(spark, [(1, 0)])
    assert bm.recommend(rows, users, params, discrete=True).count() == bm.recommend(rows, users, params).count()


def test_unknown_sampling_is_an_error(spark):
    with pytest.raises(ValueError):
        rs.neighbours(history(spark, HISTORY), evolving(spark, [10]), RefitParams(sampling="slices"))


def test_discretised_and_preparation(spark):
    v = spark.createDataFrame([(1, 1, 0.1234567890123459)], "user_id long, item_id long, value double")
    assert bm.discretised(v).first().value == 123456789012345
    rows = baskets(spark, [(1, 1, [1, 2]), (1, 2, [3]), (2, 1, [4, 5])])
    assert prep.prune(rows, 2, 1).count() == 2
    assert prep.stats(rows).first().n_items == 5
