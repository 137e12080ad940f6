"""The registered queries: each with a function of (spark, sf_dir) and, where SQL has it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.decays import POSITION_WEIGHTS, SCORE_DECAYS
from palimpsest.functions.held import stored
from palimpsest.functions.similarity import SIMILARITIES, softmax
from palimpsest.operators import baskets as bm
from palimpsest.operators import items as im
from palimpsest.operators import metrics as mm
from palimpsest.operators import prep
from palimpsest.operators import retrain_baskets as rb
from palimpsest.operators import retrain_sessions as rs
from palimpsest.operators import sessions as sm
from palimpsest.operators.baskets import BasketParams
from palimpsest.operators.retrain_sessions import RefitParams
from palimpsest.operators.sessions import SessionParams
from palimpsest.plans import changes as C
from palimpsest.plans import incremental as inc
from palimpsest.plans import sql as S
from palimpsest.sources import readers, tables, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SESSIONS = SessionParams(k=10, m=50)
SHOP = BasketParams(group_size=7, r_basket=0.9, r_group=0.7, k=20, alpha=0.7, permutations=32, jaccard_threshold=0.1)
N_BANDS, BAND_ROWS = 16, 2
ACTIVE = 45


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


#: Which users are queries: a tenth or a fiftieth, as the SQL of the queries says, or all in those named ..._all.
TENTH, FIFTIETH, ALL = "user_id % 10 = 0", "user_id % 50 = 0", "user_id IS NOT NULL"


def for_all(name: str, of: str) -> None:
    """Registers the query ``of`` again, as ``name``, with all users as queries: function and SQL differ in nothing else."""
    SQL[name] = SQL[of].replace(TENTH, ALL).replace(FIFTIETH, ALL)
    QUERIES[name] = lambda spark, d: QUERIES[of](spark, d, ALL)


def six(name: str):
    """Six digits, a little off the half, so that two ways to round agree."""
    return F.round(F.col(name) + 3e-10, 6).alias(name)


# Item similarity


@query("ib_user_counts", f"WITH {S.BASKETS} SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id")
def _(spark, d):
    return im.user_counts(tables.interactions(spark, d))


_ACTIVE = f"active AS (SELECT * FROM interactions WHERE user_id IN (SELECT user_id FROM interactions GROUP BY user_id HAVING count(*) < {ACTIVE}))"


@query("ib_active_interactions", f"WITH {S.BASKETS}, {_ACTIVE} SELECT user_id, item_id FROM active")
def _(spark, d):
    return im.active(tables.interactions(spark, d), ACTIVE)


@query("ib_item_popularity", f"WITH {S.BASKETS} SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id")
def _(spark, d):
    return im.popularity(tables.interactions(spark, d))


@query("ib_cooccurrence", f"WITH {S.BASKETS}, {_ACTIVE} SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_cooc FROM active a JOIN active b ON a.user_id = b.user_id AND a.item_id > b.item_id GROUP BY ALL")
def _(spark, d):
    return im.cooccurrences(im.active(tables.interactions(spark, d), ACTIVE))


def _jaccard_sql(rows: str) -> str:
    return f"""WITH {S.BASKETS}, kept AS ({rows}), pop AS (SELECT item_id, count(*) AS n FROM kept GROUP BY item_id),
    co AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_cooc FROM kept a JOIN kept b ON a.user_id = b.user_id AND a.item_id > b.item_id GROUP BY ALL)
    SELECT * FROM (SELECT item_a, item_b, n_cooc, x.n AS occ_a, y.n AS occ_b, n_cooc::DOUBLE / (x.n + y.n - n_cooc) AS jaccard
    FROM co JOIN pop x ON x.item_id = item_a JOIN pop y ON y.item_id = item_b) WHERE jaccard > 0.05"""


@query("ib_jaccard", _jaccard_sql("SELECT * FROM interactions"))
def _(spark, d):
    return im.similarities(tables.interactions(spark, d))


@query("ib_forget_users", _jaccard_sql("SELECT * FROM interactions WHERE user_id % 50 <> 7"))
def _(spark, d):
    rows = stored(tables.interactions(spark, d))
    gone = C.forget_users(rows, rows.filter("user_id % 50 = 7"))
    return inc.update_items(rows, im.similarities(rows), gone).result


# Sessions


def _history(spark, d):
    return tables.history(spark, d)


def _total(spark, d):
    return _history(spark, d).agg(F.count(F.lit(1)).alias("n"))


_VS = S.sessions(SESSIONS.m, SESSIONS.k)


@query("vs_session_recency", f"WITH {_VS} SELECT session_id, max_ord FROM recency")
def _(spark, d):
    return sm.recency(_history(spark, d))


@query("vs_item_index_top_m", f"WITH {S.sessions(10, 10)} SELECT item_id, session_id, max_ord FROM idx")
def _(spark, d):
    return sm.index(sm.item_sessions(_history(spark, d)), 10)


@query("vs_item_idf", f"WITH {_VS} SELECT item_id, round(idf + 3e-10, 6) AS idf FROM idf")
def _(spark, d):
    return sm.idf(sm.item_sessions(_history(spark, d)), _total(spark, d)).select("item_id", six("idf"))


@query("vs_evolving_weights", f"WITH {_VS} SELECT session_id, item_id, w FROM weights")
def _(spark, d):
    return sm.click_weights(tables.evolving(spark, d))


@query("vs_session_lengths", f"WITH {_VS} SELECT session_id, length FROM lens")
def _(spark, d):
    return sm.lengths(tables.evolving(spark, d))


def _matches(spark, d, m=SESSIONS.m):
    return sm.matches(sm.index(sm.item_sessions(_history(spark, d)), m), tables.evolving(spark, d), m)


@query("vs_matches", f"WITH {S.sessions(10, 10)} SELECT session_id, hist_id, max_ord FROM kept")
def _(spark, d):
    return _matches(spark, d, 10).select("session_id", "hist_id", "max_ord")


@query("vs_similarities", f"WITH {_VS} SELECT session_id, hist_id, sum_w, length, match_position, sum_w::DOUBLE / length AS similarity FROM sims")
def _(spark, d):
    rows = sm.with_similarity(_matches(spark, d))
    return rows.select("session_id", "hist_id", "sum_w", "length", F.col("match_position").cast("bigint").alias("match_position"), "similarity")


@query("vs_neighbors_top_k", f"WITH {_VS} SELECT session_id, hist_id, similarity, match_position FROM near")
def _(spark, d):
    return sm.neighbours(_matches(spark, d), SESSIONS.k).select("session_id", "hist_id", "similarity", F.col("match_position").cast("bigint").alias("match_position"))


_SCORES = "SELECT session_id, item_id, round(score + 3e-10, 6) AS score FROM scored"


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("session_id", "item_id", six("score"))


@query("vs_item_scores", f"WITH {_VS} {_SCORES}")
def _(spark, d):
    return _rounded(sm.model(_history(spark, d), tables.evolving(spark, d), SESSIONS, _total(spark, d)))


_LISTED = "SELECT c.session_id, coalesce(string_agg(s.item_id::VARCHAR, ',' ORDER BY s.r), '') AS recommended FROM current c LEFT JOIN served s ON s.session_id = c.session_id AND s.r <= 20 GROUP BY c.session_id"


def _listed(rows: DataFrame, name: str = "recommended"):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


@query("vs_recommend_top20", f"WITH {_VS} {_LISTED}")
def _(spark, d):
    evolving = tables.evolving(spark, d)
    served = sm.serve(sm.model(_history(spark, d), evolving, SESSIONS, _total(spark, d)), evolving)
    return served.select("session_id", _listed(served))


_PREFIXES = """lasts AS (SELECT session_id, max(position) AS n FROM evolving GROUP BY session_id),
evo AS (SELECT e.session_id::VARCHAR || ':' || p.p::VARCHAR AS session_id, e.item_id, e.position FROM evolving e JOIN lasts l USING (session_id), unnest(range(e.position, l.n)) AS p(p))"""


@query(
    "vs_prefix_replay",
    f"""WITH {S.sessions(SESSIONS.m, SESSIONS.k, evolving=_PREFIXES)}, listed AS ({_LISTED}),
    keyed AS (SELECT split_part(session_id, ':', 1)::BIGINT AS session_id, split_part(session_id, ':', 2)::INT AS prefix, recommended FROM listed)
    SELECT k.session_id, k.prefix, any_value(k.recommended) || ';' || string_agg(e.item_id::VARCHAR, ',' ORDER BY e.position) AS line
    FROM keyed k JOIN evolving e ON e.session_id = k.session_id AND e.position > k.prefix GROUP BY k.session_id, k.prefix""",
)
def _(spark, d):
    rows = sm.replay(_history(spark, d), tables.evolving(spark, d), SESSIONS, _total(spark, d))
    return rows.select("session_id", "prefix", writers.prediction_line().alias("line"))


def _updated(spark, d, changes) -> DataFrame:
    history, evolving, total = _history(spark, d), tables.evolving(spark, d), _total(spark, d)
    old = sm.model(history, evolving, SESSIONS, total)
    return _rounded(inc.update_sessions(history, evolving, old, changes(history), SESSIONS, total).result)


_EDIT = "history AS (SELECT * FROM base_history {})"


@query("vs_forget_clicks", f"WITH {S.sessions(SESSIONS.m, SESSIONS.k, history=_EDIT.format('WHERE (session_id * 31 + item_id * 17) % 1000 <> 7'))} {_SCORES}")
def _(spark, d):
    return _updated(spark, d, lambda h: C.deletions(h.filter("(session_id * 31 + item_id * 17) % 1000 = 7")))


@query("vs_forget_sessions", f"WITH {S.sessions(SESSIONS.m, SESSIONS.k, history=_EDIT.format('WHERE session_id % 997 <> 3'))} {_SCORES}")
def _(spark, d):
    return _updated(spark, d, lambda h: C.forget_sessions(h, h.filter("session_id % 997 = 3")))


@query("vs_add_clicks", f"WITH {S.sessions(SESSIONS.m, SESSIONS.k, history=_EDIT.format('UNION ALL SELECT session_id, item_id + 1, ord + 3600 FROM base_history WHERE (session_id * 13 + item_id) % 1000 = 5'))} {_SCORES}")
def _(spark, d):
    return _updated(spark, d, lambda h: C.insertions(h.filter("(session_id * 13 + item_id) % 1000 = 5").select("session_id", (F.col("item_id") + 1).alias("item_id"), (F.col("ord") + 3600).alias("ord"))))


@query(
    "vs_mixed_changes",
    f"""WITH {S.sessions(SESSIONS.m, SESSIONS.k, history=_EDIT.format("WHERE (session_id * 31 + item_id * 17) % 1000 <> 7 UNION ALL SELECT session_id, item_id + 1, ord + 3600 FROM base_history WHERE (session_id * 13 + item_id) % 1000 = 5"))} {_SCORES}""",
)
def _(spark, d):
    def changes(h):
        more = h.filter("(session_id * 13 + item_id) % 1000 = 5").select("session_id", (F.col("item_id") + 1).alias("item_id"), (F.col("ord") + 3600).alias("ord"))
        return C.insertions(more).unionByName(C.deletions(h.filter("(session_id * 31 + item_id * 17) % 1000 = 7")))

    return _updated(spark, d, changes)


@query(
    "vs_event_clicks",
    """WITH c AS (SELECT user_id * 100000000 + strftime(ts, '%Y%m%d')::BIGINT AS session_id, (props->>'$.k')::BIGINT AS item_id, floor(epoch(ts))::BIGINT AS ord FROM events)
    SELECT session_id, max(ord) AS max_ord, count(*) AS n FROM c WHERE item_id IS NOT NULL GROUP BY session_id""",
)
def _(spark, d):
    return tables.event_clicks(spark, d).groupBy("session_id").agg(F.max("ord").alias("max_ord"), F.count(F.lit(1)).alias("n"))


# Baskets


def _queries(baskets: DataFrame, users: str = TENTH) -> DataFrame:
    return baskets.select("user_id").distinct().filter(users)


_VALUES = "SELECT user_id, item_id, round(value + 3e-10, 6) AS value FROM"


def _vector(rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(*(key or ("user_id", "item_id")), six("value"))


@query("tifu_group_vectors", f"WITH {S.tifu()} SELECT user_id, grp::INT AS grp, item_id, round(value + 3e-10, 6) AS value FROM gv")
def _(spark, d):
    return _vector(bm.group_vectors(tables.baskets(spark, d), SHOP), "user_id", "grp", "item_id")


@query("tifu_user_vectors", f"WITH {S.tifu()} {_VALUES} uv")
def _(spark, d):
    return _vector(bm.user_vectors(tables.baskets(spark, d), SHOP))


@query("tifu_neighbors_exact", f"WITH {S.tifu()}, {S.nearest(SHOP.k)} SELECT user_id, other_id, jaccard FROM nn")
def _(spark, d, users=TENTH):
    sets = stored(_sets(spark, d))
    return bm.exact_neighbours(sets, _queries(sets, users), SHOP.k)


@query("tifu_recommend", f"WITH {S.tifu()}, {S.nearest(SHOP.k)}, {S.merged(SHOP.alpha)} {_VALUES} rec")
def _(spark, d, users=TENTH):
    baskets = stored(tables.baskets(spark, d))
    return _vector(bm.recommend(baskets, _queries(baskets, users), SHOP))


_DELETED = """left_over AS (SELECT * FROM all_baskets WHERE NOT (user_id % 5 = 0 AND basket_no = 2)),
b AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY basket_no) AS basket_no, item_id FROM left_over)"""


@query("tifu_delete_baskets", f"WITH {S.tifu(_DELETED)}, {S.nearest(SHOP.k)}, {S.merged(SHOP.alpha)} {_VALUES} rec")
def _(spark, d, users=TENTH):
    baskets = stored(tables.baskets(spark, d))
    return _vector(inc.update_baskets(baskets, _queries(baskets, users), SHOP, gone=baskets.filter("user_id % 5 = 0 AND basket_no = 2")).result)


_ADDED = """ends AS (SELECT user_id, max(basket_no) AS last FROM all_baskets GROUP BY user_id),
b AS (SELECT user_id, basket_no, item_id FROM all_baskets UNION ALL SELECT a.user_id, e.last + 1, a.item_id FROM all_baskets a JOIN ends e ON e.user_id = a.user_id WHERE a.user_id % 7 = 0 AND a.basket_no = 1)"""


@query("tifu_add_baskets", f"WITH {S.tifu(_ADDED)}, {S.nearest(SHOP.k)}, {S.merged(SHOP.alpha)} {_VALUES} rec")
def _(spark, d, users=TENTH):
    baskets = stored(tables.baskets(spark, d))
    return _vector(inc.update_baskets(baskets, _queries(baskets, users), SHOP, more=baskets.filter("user_id % 7 = 0 AND basket_no = 1")).result)


_LSH = f"{S.tifu()}, {S.signatures(SHOP.permutations, SHOP.seed)}, {S.bands(N_BANDS, BAND_ROWS)}"
_CANDIDATES = "cand AS (SELECT DISTINCT a.user_id, c.user_id AS other_id FROM band a JOIN band c ON a.band = c.band AND a.key = c.key AND a.user_id <> c.user_id WHERE a.user_id % 10 = 0)"


def _sets(spark, d) -> DataFrame:
    return tables.baskets(spark, d).select("user_id", F.explode("items").alias("item_id")).distinct()


@query("lsh_signatures", f"WITH {_LSH} SELECT user_id, j::INT AS j, h FROM sig")
def _(spark, d):
    signed = bm.signatures(_sets(spark, d), SHOP.permutations, SHOP.seed)
    return signed.select("user_id", F.posexplode("signature").alias("j", "h"))


@query("lsh_bands", f"WITH {_LSH} SELECT user_id, band, key FROM band")
def _(spark, d):
    placed = bm.buckets(bm.signatures(_sets(spark, d), SHOP.permutations, SHOP.seed), N_BANDS, BAND_ROWS)
    return placed.select("user_id", "band", _listed(placed, "rows").alias("key"))


@query("lsh_candidates", f"WITH {_LSH}, {_CANDIDATES} SELECT user_id, other_id FROM cand")
def _(spark, d, users=TENTH):
    sets = _sets(spark, d)
    return bm.lsh_candidates(sets, _queries(sets, users), SHOP.permutations, N_BANDS, BAND_ROWS, SHOP.seed)


@query(
    "tifu_recommend_lsh",
    f"WITH {_LSH}, {_CANDIDATES}, {S.nearest(SHOP.k, candidates='JOIN cand c ON c.user_id = t.user_id AND c.other_id = t.other_id')}, {S.merged(SHOP.alpha)} {_VALUES} rec",
)
def _(spark, d, users=TENTH):
    baskets = stored(tables.baskets(spark, d))
    vectors = stored(bm.user_vectors(baskets, SHOP))
    sets = vectors.select("user_id", "item_id")
    found = bm.lsh_candidates(sets, _queries(sets, users), SHOP.permutations, N_BANDS, BAND_ROWS, SHOP.seed)
    return _vector(bm.merged(vectors, stored(bm.neighbours(bm.overlaps(sets, _queries(sets, users), found), SHOP.k)), SHOP.alpha))


# Changes


_TWICE = "(SELECT session_id, item_id, 1 AS diff FROM base_history UNION ALL SELECT session_id, item_id, -1 FROM base_history WHERE item_id % 3 = 0)"


@query("changes_consolidate", f"WITH {S.CLICKS} SELECT session_id, item_id, sum(diff)::BIGINT AS diff FROM {_TWICE} GROUP BY ALL HAVING sum(diff) <> 0")
def _(spark, d):
    rows = _history(spark, d).select("session_id", "item_id")
    return C.consolidate(C.insertions(rows).unionByName(C.deletions(rows.filter("item_id % 3 = 0"))))


@query(
    "changes_delta",
    f"""WITH {S.CLICKS}, o AS (SELECT item_id, count(*) AS n FROM base_history GROUP BY item_id), w AS (SELECT item_id, count(*) AS n FROM base_history WHERE session_id % 97 <> 3 GROUP BY item_id)
    SELECT * FROM (SELECT *, 1::BIGINT AS diff FROM (SELECT * FROM w EXCEPT SELECT * FROM o)) UNION ALL (SELECT *, -1::BIGINT FROM (SELECT * FROM o EXCEPT SELECT * FROM w))""",
)
def _(spark, d):
    rows = _history(spark, d)
    return C.delta(im.popularity(rows), im.popularity(rows.filter("session_id % 97 <> 3")))


# Metrics, on each user's last basket


def _evaluated(spark, d, users: str = TENTH) -> tuple[DataFrame, DataFrame]:
    baskets = stored(tables.baskets(spark, d))
    numbered = baskets.withColumn("last", F.max("basket_no").over(W.partitionBy("user_id")))
    past = numbered.filter("basket_no < last").drop("last")
    truth = numbered.filter("basket_no = last").select("user_id", F.explode("items").alias("item_id")).distinct()
    return stored(bm.recommend_top(past, _queries(past, users), SHOP, 20)), stored(truth)


_EVAL = f"""{S.tifu(S.split_baskets())}, {S.nearest(SHOP.k)}, {S.merged(SHOP.alpha)},
pred AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value * 1e9 + 0.3) DESC, item_id) AS rank FROM rec QUALIFY rank <= 20),
nt AS (SELECT user_id, count(*) AS n_true FROM truth GROUP BY user_id),
pu AS (SELECT user_id, count(*) FILTER (rank <= 10) AS n_shown FROM pred GROUP BY user_id),
hit AS (SELECT p.user_id, p.rank FROM pred p JOIN truth t ON t.user_id = p.user_id AND t.item_id = p.item_id WHERE p.rank <= 10),
m AS (
  SELECT pu.user_id, pu.n_shown, nt.n_true, (SELECT count(*) FROM hit h WHERE h.user_id = pu.user_id) AS n_hit,
         coalesce((SELECT sum(1 / log2(h.rank + 1)) FROM hit h WHERE h.user_id = pu.user_id AND h.rank <= least(10, nt.n_true)), 0)
         / list_sum(list_transform(range(1, least(10, nt.n_true) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
  FROM pu JOIN nt ON nt.user_id = pu.user_id
)"""


@query("metrics_ndcg", f"WITH {_EVAL} SELECT user_id, round(ndcg + 3e-10, 6) AS ndcg FROM m")
def _(spark, d, users=TENTH):
    return mm.ndcg(*_evaluated(spark, d, users), 10).select("user_id", six("ndcg"))


@query("metrics_prf", f"WITH {_EVAL}, pr AS (SELECT *, n_hit::DOUBLE / n_shown AS p, n_hit::DOUBLE / n_true AS r FROM m) SELECT user_id, n_hit AS n_correct, p AS precision, r AS recall, round(CASE WHEN n_hit > 0 THEN 2 * p * r / (p + r) ELSE 0 END + 3e-10, 6) AS f1 FROM pr")
def _(spark, d, users=TENTH):
    rows = mm.precision_recall(*_evaluated(spark, d, users), 10)
    return rows.select("user_id", F.col("n_correct").cast("bigint").alias("n_correct"), "precision", "recall", six("f1"))


@query("metrics_hit", f"WITH {_EVAL} SELECT user_id, (n_hit > 0)::INT AS hit FROM m")
def _(spark, d, users=TENTH):
    return mm.hit(*_evaluated(spark, d, users), 10)


@query(
    "metrics_summary",
    f"""WITH {_EVAL}, pr AS (SELECT *, n_hit::DOUBLE / n_shown AS p, n_hit::DOUBLE / n_true AS r FROM m)
    SELECT round(avg(p) + 3e-10, 6) AS precision, round(avg(r) + 3e-10, 6) AS recall, round(avg(CASE WHEN n_hit > 0 THEN 2 * p * r / (p + r) ELSE 0 END) + 3e-10, 6) AS f1, round(avg(ndcg) + 3e-10, 6) AS ndcg,
    round(count(*) FILTER (n_hit > 0)::DOUBLE / (SELECT count(*) FROM pu) + 3e-10, 6) AS hit_ratio FROM pr""",
)
def _(spark, d, users=TENTH):
    rows = mm.summary(*_evaluated(spark, d, users), 10)
    return rows.select(*(six(c) for c in rows.columns))


# The refitted session model


@query("base_outlier_sessions", f"WITH {S.CLICKS}, s AS (SELECT session_id, count(*) AS n FROM base_history GROUP BY session_id) SELECT h.session_id, h.item_id, h.ord FROM base_history h JOIN s USING (session_id) WHERE s.n < (SELECT quantile_cont(n, 0.995) FROM s)")
def _(spark, d):
    return rs.without_outliers(_history(spark, d))


@query("base_last_n_days", f"WITH {S.CLICKS} SELECT * FROM base_history WHERE ord >= ((SELECT max(ord) FROM base_history) // 86400 - 30) * 86400")
def _(spark, d):
    return rs.last_days(_history(spark, d), 30)


@query("base_click_idf", f"WITH {S.CLICKS} SELECT item_id, round(ln((SELECT count(DISTINCT session_id) FROM base_history)::DOUBLE / count(*)) + 3e-10, 6) AS idf FROM base_history GROUP BY item_id")
def _(spark, d):
    return rs.idf(_history(spark, d)).select("item_id", six("idf"))


@query("base_item_pop", f"WITH {S.CLICKS}, c AS (SELECT item_id, count(DISTINCT session_id) AS n FROM base_history GROUP BY item_id) SELECT item_id, n::DOUBLE / (SELECT max(n) FROM c) AS popularity FROM c")
def _(spark, d):
    return rs.item_popularity(_history(spark, d))


_DECAYS = {"linear": "CASE WHEN i <= 100 THEN 1 - 0.1 * i ELSE 0 END", "same": "1.0", "div": "1.0 / i", "log": "1 / log10(i + 1.7)", "quadratic": "1.0 / (i * i)"}
_WEIGHTS = {"linear": "CASE WHEN i <= 10 THEN 1 - 0.1 * (n - i) ELSE 0 END", "same": "1.0", "div": "i::DOUBLE / n", "log": "1 / log10((n - i) + 1.7)", "quadratic": "(i::DOUBLE / n) * (i::DOUBLE / n)"}


@query(
    "base_vsknn_weights",
    f"WITH {S.CLICKS}, e AS (SELECT session_id, position AS i, count(*) OVER (PARTITION BY session_id) AS n FROM evolving) SELECT session_id, i::INT AS position, "
    + ", ".join([f"round(({x})::DOUBLE, 6) AS decay_{k}" for k, x in _DECAYS.items()] + [f"round(({x})::DOUBLE, 6) AS weight_{k}" for k, x in _WEIGHTS.items()])
    + " FROM e",
)
def _(spark, d):
    rows = tables.evolving(spark, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("session_id")))
    i, n = F.col("position"), F.col("n")
    out = [F.round(f(i), 6).alias(f"decay_{k}") for k, f in SCORE_DECAYS.items()] + [F.round(f(i, n), 6).alias(f"weight_{k}") for k, f in POSITION_WEIGHTS.items()]
    return rows.select("session_id", "position", *out)


@query(
    "base_similarity_functions",
    f"""WITH {S.CLICKS}, h AS (SELECT DISTINCT session_id, item_id FROM base_history), e AS (SELECT DISTINCT session_id, item_id FROM evolving),
    hn AS (SELECT session_id, count(*) AS n FROM h GROUP BY session_id), en AS (SELECT session_id, count(*) AS n FROM e GROUP BY session_id),
    p AS (SELECT e.session_id, h.session_id AS hist_id, count(*) AS c FROM e JOIN h USING (item_id) GROUP BY ALL)
    SELECT p.session_id, p.hist_id, c::DOUBLE / (a.n + b.n - c) AS jaccard, round(c / (sqrt(a.n::DOUBLE) * sqrt(b.n::DOUBLE)), 6) AS cosine, c::DOUBLE / (a.n + b.n - c) AS tanimoto, (2 * c)::DOUBLE / (2 * c + a.n + b.n) AS "binary"
    FROM p JOIN en a ON a.session_id = p.session_id JOIN hn b ON b.session_id = p.hist_id""",
)
def _(spark, d):
    h = _history(spark, d).select("session_id", "item_id").distinct()
    e = tables.evolving(spark, d).select("session_id", "item_id").distinct()
    hn = h.groupBy(F.col("session_id").alias("hist_id")).agg(F.count(F.lit(1)).alias("b"))
    en = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("a"))
    pairs = e.join(h.withColumnRenamed("session_id", "hist_id"), "item_id").groupBy("session_id", "hist_id").agg(F.count(F.lit(1)).alias("c"))
    values = {k: f(F.col("c"), F.col("a"), F.col("b")) for k, f in SIMILARITIES.items()}
    values["cosine"] = F.round(values["cosine"], 6)
    return pairs.join(en, "session_id").join(hn, "hist_id").select("session_id", "hist_id", *(v.alias(k) for k, v in values.items()))


_REFIT = f"""WITH {S.CLICKS}, n AS (SELECT session_id, max(position) AS n FROM evolving GROUP BY session_id),
pw AS (SELECT e.session_id, e.item_id, max(e.position) AS p, any_value(n.n) AS n FROM evolving e JOIN n USING (session_id) GROUP BY e.session_id, e.item_id),
pd AS (SELECT *, p::DOUBLE / n AS w, n - p + 1 AS back, count(*) OVER (PARTITION BY session_id) AS nd FROM pw),
h AS (SELECT DISTINCT session_id AS hist_id, item_id, max(ord) OVER (PARTITION BY session_id) AS last FROM base_history),
pairs AS (SELECT d.session_id, h.hist_id, sum(d.w) / any_value(d.nd) AS similarity, min(d.back) AS step, any_value(h.last) AS last FROM pd d JOIN h USING (item_id) GROUP BY d.session_id, h.hist_id),
sampled AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last DESC, hist_id) <= 50),
near AS (SELECT * FROM sampled QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY floor(similarity * 1e9 + 0.3) DESC, hist_id) <= 10),
cur AS (SELECT session_id, arg_max(item_id, position) AS current FROM evolving GROUP BY session_id),
raw AS (SELECT n.session_id, h.item_id, sum(n.similarity / n.step) AS score FROM near n JOIN h USING (hist_id) JOIN cur c ON c.session_id = n.session_id WHERE h.item_id <> c.current GROUP BY n.session_id, h.item_id)"""


@query("base_vsknn_neighbors", f"{_REFIT} SELECT session_id, hist_id, round(similarity + 3e-10, 6) AS similarity, step::INT AS step FROM near")
def _(spark, d):
    rows = rs.neighbours(_history(spark, d), tables.evolving(spark, d), RefitParams(k=10, sample_size=50))
    return rows.select("session_id", "hist_id", six("similarity"), "step")


@query("base_vsknn_scores", f"{_REFIT} SELECT session_id, item_id, round(score / max(score) OVER (PARTITION BY session_id) + 3e-10, 6) AS score FROM raw")
def _(spark, d):
    return _rounded(rs.scores(_history(spark, d), tables.evolving(spark, d), RefitParams(k=10, sample_size=50)))


# The refitted basket model


@query("base_tifu_mean_history", f"WITH {S.tifu()}, n AS (SELECT user_id, max(basket_no) AS n FROM b GROUP BY user_id) SELECT b.user_id, b.item_id, count(*)::DOUBLE / any_value(n.n) AS value FROM b JOIN n USING (user_id) GROUP BY b.user_id, b.item_id")
def _(spark, d):
    return rb.mean_history(tables.baskets(spark, d))


@query("base_tifu_decayed_history", f"WITH {S.tifu()}, n AS (SELECT user_id, max(basket_no) AS n FROM b GROUP BY user_id) SELECT b.user_id, b.item_id, round(sum(pow(0.9, n.n - b.basket_no)) / any_value(n.n) + 3e-10, 6) AS value FROM b JOIN n USING (user_id) GROUP BY b.user_id, b.item_id")
def _(spark, d):
    return _vector(rb.decayed_history(tables.baskets(spark, d), 0.9))


_GROUPED = f"""{S.tifu()}, n AS (SELECT user_id, max(basket_no) AS n FROM b GROUP BY user_id),
place AS (
  SELECT b.user_id, b.item_id, b.basket_no, n.n, CASE WHEN n.n < 7 THEN b.basket_no WHEN b.basket_no <= (7 - n.n % 7) * (n.n // 7) THEN (b.basket_no + n.n // 7 - 1) // (n.n // 7)
         ELSE 7 - n.n % 7 + (b.basket_no - (7 - n.n % 7) * (n.n // 7) + n.n // 7) // (n.n // 7 + 1) END AS g,
         CASE WHEN n.n < 7 THEN 1 WHEN b.basket_no <= (7 - n.n % 7) * (n.n // 7) THEN n.n // 7 ELSE n.n // 7 + 1 END AS size
  FROM b JOIN n USING (user_id)
),
gh AS (SELECT user_id, item_id, sum(pow(0.9, n - basket_no) / size * pow(0.7, 7 - g) / least(n, 7)) AS value FROM place GROUP BY user_id, item_id)"""


@query("base_tifu_history", f"WITH {_GROUPED} {_VALUES} gh")
def _(spark, d):
    return _vector(rb.grouped_history(tables.baskets(spark, d), 7, 0.9, 0.7))


_EUCLID = f"""{_GROUPED}, q AS (SELECT * FROM gh WHERE user_id % 50 = 0), norms AS (SELECT user_id, sum(value * value) AS norm FROM gh GROUP BY user_id),
dots AS (SELECT q.user_id, g.user_id AS other_id, sum(q.value * g.value) AS dot FROM q JOIN gh g USING (item_id) GROUP BY q.user_id, g.user_id),
dist AS (SELECT a.user_id, c.user_id AS other_id, sqrt(greatest(a.norm + c.norm - 2 * coalesce(t.dot, 0), 0)) AS distance
  FROM norms a CROSS JOIN norms c LEFT JOIN dots t ON t.user_id = a.user_id AND t.other_id = c.user_id WHERE a.user_id % 50 = 0),
en AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(distance * 1e9 + 0.3), other_id) <= 15)"""


@query("base_tifu_knn_euclid", f"WITH {_EUCLID} SELECT user_id, other_id, round(distance, 5) AS distance FROM en")
def _(spark, d, users=FIFTIETH):
    vectors = stored(rb.grouped_history(tables.baskets(spark, d), 7, 0.9, 0.7))
    return rb.euclidean_neighbours(vectors.filter(users), vectors, 15).select("user_id", "other_id", F.round("distance", 5).alias("distance"))


@query(
    "base_tifu_merge",
    f"WITH {_EUCLID} {_VALUES} (SELECT user_id, item_id, sum(value) AS value FROM (SELECT user_id, item_id, 0.7 * value AS value FROM q UNION ALL SELECT n.user_id, g.item_id, (1 - 0.7) * g.value / 15 FROM en n JOIN gh g ON g.user_id = n.other_id) GROUP BY user_id, item_id)",
)
def _(spark, d, users=FIFTIETH):
    vectors = stored(rb.grouped_history(tables.baskets(spark, d), 7, 0.9, 0.7))
    queries = vectors.filter(users)
    near = stored(rb.euclidean_neighbours(queries, vectors, 15))
    return _vector(rb.merge_history(queries, vectors, near, 0.7))


_FUTURE = """ends AS (SELECT user_id, max(basket_no) AS last FROM all_baskets GROUP BY user_id),
b AS (SELECT a.* FROM all_baskets a JOIN ends e ON e.user_id = a.user_id WHERE a.basket_no < e.last),
fut AS (SELECT DISTINCT a.user_id, a.item_id FROM all_baskets a JOIN ends e ON e.user_id = a.user_id WHERE a.basket_no = e.last)"""


def _past_and_future(spark, d):
    numbered = stored(tables.baskets(spark, d)).withColumn("last", F.max("basket_no").over(W.partitionBy("user_id")))
    return numbered.filter("basket_no < last").drop("last"), numbered.filter("basket_no = last").select("user_id", F.lit(1).alias("basket_no"), "items")


@query(
    "base_tifu_merge_future",
    f"""WITH {_EUCLID.replace("b AS (SELECT * FROM all_baskets)", _FUTURE)} {_VALUES} (SELECT user_id, item_id, sum(value) AS value FROM (
    SELECT user_id, item_id, 0.6 * 0.7 * value AS value FROM q UNION ALL SELECT n.user_id, g.item_id, 0.6 * (1 - 0.7) * g.value / 15 FROM en n JOIN gh g ON g.user_id = n.other_id
    UNION ALL SELECT n.user_id, f.item_id, (1 - 0.6) * 1.0 / 15 FROM en n JOIN fut f ON f.user_id = n.other_id) GROUP BY user_id, item_id)""",
)
def _(spark, d, users=FIFTIETH):
    past, future = _past_and_future(spark, d)
    vectors = stored(rb.grouped_history(past, 7, 0.9, 0.7))
    queries = vectors.filter(users)
    near = stored(rb.euclidean_neighbours(queries, vectors, 15))
    return _vector(rb.merge_history_and_future(queries, vectors, near, future, 0.7, 0.6))


@query("base_neighbor_frequency", f"""WITH {_EUCLID.replace("b AS (SELECT * FROM all_baskets)", _FUTURE)} SELECT n.user_id, f.item_id, count(*)::DOUBLE AS value FROM en n JOIN fut f ON f.user_id = n.other_id GROUP BY n.user_id, f.item_id""")
def _(spark, d, users=FIFTIETH):
    past, future = _past_and_future(spark, d)
    vectors = stored(rb.grouped_history(past, 7, 0.9, 0.7))
    return rb.most_frequent(stored(rb.euclidean_neighbours(vectors.filter(users), vectors, 15)), future)


@query("base_softmax", f"WITH {S.tifu()}, x AS (SELECT *, exp(value - max(value) OVER (PARTITION BY user_id)) AS e FROM uv) SELECT user_id, item_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS value FROM x")
def _(spark, d):
    vectors = bm.user_vectors(tables.baskets(spark, d), SHOP)
    return vectors.select("user_id", "item_id", F.round(softmax(F.col("value"), W.partitionBy("user_id")), 6).alias("value"))


@query(
    "base_split",
    f"""WITH {S.tifu()}, u AS (SELECT user_id FROM b GROUP BY user_id HAVING count(DISTINCT basket_no) >= 2), r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS p, count(*) OVER () AS t FROM u)
    SELECT user_id, CASE WHEN p <= floor(t * 0.8 * (1 - 0.1)) THEN 'train' WHEN p <= floor(t * 0.8) THEN 'validation' ELSE 'test' END AS part FROM r""",
)
def _(spark, d):
    return rb.split(tables.baskets(spark, d), validate=0.1)


# Datasets


@query("prep_parse_baskets", f"WITH {S.BASKETS} SELECT user_id, basket_no::INT AS basket_no, string_agg((item_id - 1)::VARCHAR, ',' ORDER BY item_id) AS items FROM all_baskets GROUP BY user_id, basket_no")
def _(spark, d):
    raw = tables.baskets(spark, d).select("user_id", "basket_no", F.explode("items").alias("raw_item"))
    rows = readers.parse_baskets(raw)
    return rows.select("user_id", "basket_no", _listed(rows, "items"))


@query("prep_vocab", f"WITH {S.BASKETS}, v AS (SELECT DISTINCT item_id FROM lines) SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS code FROM v")
def _(spark, d):
    return prep.item_codes(writers.vocabulary(tables.baskets(spark, d)))


@query("prep_stats", f"WITH {S.BASKETS}, k AS (SELECT DISTINCT user_id, basket_no FROM all_baskets) SELECT count(DISTINCT user_id) AS n_users, (SELECT count(DISTINCT item_id) FROM all_baskets) AS n_items, count(*) AS n_baskets, count(*)::DOUBLE / count(DISTINCT user_id) AS baskets_per_user FROM k")
def _(spark, d):
    return prep.stats(tables.baskets(spark, d))


@query("prep_multi_hot", f"WITH {S.BASKETS} SELECT user_id, basket_no::INT AS basket_no, item_id, 1 AS value FROM all_baskets")
def _(spark, d):
    return prep.multi_hot(tables.baskets(spark, d))


@query(
    "prep_prune",
    f"""WITH {S.BASKETS}, s AS (SELECT user_id, basket_no, count(*) AS n FROM all_baskets GROUP BY user_id, basket_no HAVING count(*) >= 4)
    SELECT user_id, basket_no::INT AS basket_no, n AS n_items FROM s QUALIFY count(*) OVER (PARTITION BY user_id) >= 5""",
)
def _(spark, d):
    return prep.prune(tables.baskets(spark, d), 4, 5).select("user_id", "basket_no", F.size("items").cast("bigint").alias("n_items"))


@query("prep_vector_text", f"WITH {S.tifu()} SELECT user_id, 'USER-' || user_id::VARCHAR || '-' || string_agg(item_id::VARCHAR || ':' || (floor(value * 1000000)::BIGINT)::VARCHAR, ';' ORDER BY item_id) AS line FROM (SELECT user_id, item_id, round(value, 9) AS value FROM uv) GROUP BY user_id")
def _(spark, d):
    vectors = bm.user_vectors(tables.baskets(spark, d), SHOP)
    whole = vectors.withColumn("value", F.floor(F.round("value", 9) * 1_000_000).cast("bigint"))
    return writers.vector_lines(whole, "USER")


@query("prep_first_interactions", f"WITH {S.BASKETS} SELECT user_id, item_id FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 30")
def _(spark, d):
    return readers.first_interactions(tables.interactions(spark, d), 30, "item_id")


# Deltas of results, and how many keys change


_GONE_CLICKS = "WHERE (session_id * 31 + item_id * 17) % 1000 <> 7"


def _between(old: str, new: str) -> str:
    """SQL: the changelog from the rows of one query to those of another."""
    return f"SELECT *, 1::BIGINT AS diff FROM (({new}) EXCEPT ({old})) UNION ALL SELECT *, -1::BIGINT AS diff FROM (({old}) EXCEPT ({new}))"


def _scored(history: str) -> str:
    return f"WITH {S.sessions(SESSIONS.m, SESSIONS.k, history=history)} {_SCORES}"


@query("vs_score_deltas", _between(_scored(S.WHOLE), _scored(_EDIT.format(_GONE_CLICKS))))
def _(spark, d):
    history, evolving, total = _history(spark, d), tables.evolving(spark, d), _total(spark, d)
    state = inc.SessionState.build(history, evolving, SESSIONS, total)
    new, affected = inc.update_session_state(state, C.deletions(history.filter("(session_id * 31 + item_id * 17) % 1000 = 7")), SESSIONS, total)
    return C.delta(*(_rounded(x.result.join(affected, "session_id", "left_semi")) for x in (state, new)))


@query("vs_changed_sessions", f"SELECT count(DISTINCT session_id) AS n_changed FROM ({_between(_scored(S.WHOLE), _scored(_EDIT.format(_GONE_CLICKS)))})")
def _(spark, d):
    return QUERIES["vs_score_deltas"](spark, d).agg(F.countDistinct("session_id").alias("n_changed"))


def _vectors_sql(baskets: str = "b AS (SELECT * FROM all_baskets)") -> str:
    return f"WITH {S.tifu(baskets)}, {S.nearest(SHOP.k)}, {S.merged(SHOP.alpha)} {_VALUES} rec"


@query("tifu_changed_users", f"SELECT DISTINCT user_id FROM ({_between(_vectors_sql(), _vectors_sql(_DELETED))})")
def _(spark, d, users=TENTH):
    baskets = stored(tables.baskets(spark, d))
    return inc.changed_users(baskets, _queries(baskets, users), SHOP, _vector, gone=baskets.filter("user_id % 5 = 0 AND basket_no = 2"))


# Vectors cut to fixed point


_CUT = "floor(value * 1e15) / 1e15 AS value"


@query(
    "tifu_recommend_discrete",
    f"""WITH {S.tifu().replace("gv AS (", "gv0 AS (").replace("last_grp AS", f"gv AS (SELECT user_id, grp, item_id, {_CUT} FROM gv0), last_grp AS").replace("uv AS (", "uv0 AS (")},
    uv AS (SELECT user_id, item_id, {_CUT} FROM uv0), {S.nearest(SHOP.k)}, {S.merged(SHOP.alpha)} {_VALUES} (SELECT user_id, item_id, {_CUT} FROM rec)""",
)
def _(spark, d, users=TENTH):
    baskets = stored(tables.baskets(spark, d))
    return _vector(bm.recommend(baskets, _queries(baskets, users), SHOP, discrete=True))


# Options of the refitted models


def _options(sample: str = "last DESC, hist_id", similarity: str = "similarity", part: str = "n.similarity / n.step", join: str = "", where: str = "") -> str:
    sql = _REFIT.replace("ORDER BY last DESC, hist_id", f"ORDER BY {sample}")
    sql = sql.replace("near AS (SELECT * FROM sampled", f"near AS (SELECT * FROM (SELECT * REPLACE ({similarity} AS similarity) FROM sampled)")
    sql = sql.replace("sum(n.similarity / n.step)", f"sum({part})").replace("WHERE h.item_id <> c.current", f"{join} WHERE h.item_id <> c.current {where}")
    return f"{sql} SELECT session_id, item_id, round(score / max(score) OVER (PARTITION BY session_id) + 3e-10, 6) AS score FROM raw"


def _refit(name: str, sql: str, params: RefitParams, now: int | None = None) -> None:
    query(name, sql)(lambda spark, d: _rounded(rs.scores(_history(spark, d), tables.evolving(spark, d), params, now)))


NOW = 1_009_843_200
_IDF = "JOIN (SELECT item_id, ln((SELECT count(DISTINCT session_id) FROM base_history)::DOUBLE / count(*)) AS idf FROM base_history GROUP BY item_id) i ON i.item_id = h.item_id"
_refit("base_vsknn_slice", _options("hist_id"), RefitParams(k=10, sample_size=50, sampling="slice"))
_refit("base_vsknn_day_decay", _options(similarity=f"similarity * pow(7.0 / 8.0, round(({NOW} - last) / 86400))"), RefitParams(k=10, sample_size=50, weighting_time=True), NOW)
_refit("base_vsknn_idf", _options(part="n.similarity / n.step * (1 + i.idf * 2)", join=_IDF), RefitParams(k=10, sample_size=50, idf_weighting=2.0))
_refit(
    "base_vsknn_no_reminders",
    _options(where="AND NOT EXISTS (SELECT 1 FROM evolving x WHERE x.session_id = n.session_id AND x.item_id = h.item_id)"),
    RefitParams(k=10, sample_size=50, remind=False),
)


@query(
    "base_lookups",
    f"""WITH {S.CLICKS} SELECT DISTINCT 'items' AS kind, session_id, item_id FROM base_history WHERE session_id % 50 = 1
    UNION ALL SELECT DISTINCT 'sessions', session_id, item_id FROM base_history WHERE item_id % 50 = 1""",
)
def _(spark, d):
    history = _history(spark, d)
    items, sessions = rs.items_of_sessions(history, history.filter("session_id % 50 = 1")), rs.sessions_of_items(history, history.filter("item_id % 50 = 1"))
    return items.select(F.lit("items").alias("kind"), "session_id", "item_id").unionByName(sessions.select(F.lit("sessions").alias("kind"), "session_id", "item_id"))


@query(
    "base_weighted_futures",
    f"""WITH {_EUCLID.replace("b AS (SELECT * FROM all_baskets)", _FUTURE)}, inv AS (SELECT *, CASE WHEN round(distance, 6) = 0 THEN 0 ELSE 1 / distance END AS v FROM en),
    e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY user_id)) AS e FROM inv), w AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS w FROM e)
    SELECT w.user_id, f.item_id, round(sum(CASE WHEN w.w = 0 THEN 1 ELSE w.w END), 4) AS value FROM w JOIN fut f ON f.user_id = w.other_id GROUP BY w.user_id, f.item_id""",
)
def _(spark, d, users=FIFTIETH):
    past, future = _past_and_future(spark, d)
    vectors = stored(rb.grouped_history(past, 7, 0.9, 0.7))
    rows = rb.weighted_futures(stored(rb.euclidean_neighbours(vectors.filter(users), vectors, 15)), future)
    return rows.select("user_id", "item_id", F.round("value", 4).alias("value"))


# Measures of twenty places, and against an ideal of all true items


_AT_20 = _EVAL.replace("rank <= 10", "rank <= 20").replace("least(10,", "least(20,")


@query(
    "metrics_summary_20",
    f"""WITH {_AT_20}, pr AS (SELECT *, n_hit::DOUBLE / n_shown AS p, n_hit::DOUBLE / n_true AS r FROM m)
    SELECT round(avg(p) + 3e-10, 6) AS precision, round(avg(r) + 3e-10, 6) AS recall, round(avg(CASE WHEN n_hit > 0 THEN 2 * p * r / (p + r) ELSE 0 END) + 3e-10, 6) AS f1, round(avg(ndcg) + 3e-10, 6) AS ndcg,
    round(count(*) FILTER (n_hit > 0)::DOUBLE / (SELECT count(*) FROM pu) + 3e-10, 6) AS hit_ratio FROM pr""",
)
def _(spark, d, users=TENTH):
    rows = mm.summary(*_evaluated(spark, d, users), 20)
    return rows.select(*(six(c) for c in rows.columns))


@query("metrics_ndcg_full", f"WITH {_EVAL.replace('h.rank <= least(10, nt.n_true)', 'h.rank <= 10').replace('range(1, least(10, nt.n_true) + 1)', 'range(1, nt.n_true + 1)')} SELECT user_id, round(ndcg + 3e-10, 6) AS ndcg FROM m")
def _(spark, d, users=TENTH):
    return mm.ndcg(*_evaluated(spark, d, users), 10, "full").select("user_id", six("ndcg"))


# Codes in the order of first sight


_SEEN = "seen AS (SELECT item_id, (row_number() OVER (ORDER BY min(seq)) - 1)::BIGINT AS code FROM (SELECT l_partkey AS item_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq FROM lineitem) GROUP BY item_id)"


def _first_seen(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("item_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("seq"))
    return prep.first_seen_codes(rows)


@query("prep_first_seen_codes", f"WITH {_SEEN} SELECT item_id, code FROM seen")
def _(spark, d):
    return _first_seen(spark, d)


@query("prep_encoded_baskets", f"WITH {S.BASKETS}, {_SEEN} SELECT user_id, basket_no::INT AS basket_no, string_agg(code::VARCHAR, ',' ORDER BY code) AS items FROM all_baskets JOIN seen USING (item_id) GROUP BY user_id, basket_no")
def _(spark, d):
    raw = tables.baskets(spark, d).select("user_id", "basket_no", F.explode("items").alias("item_id"))
    rows = readers.encoded_baskets(raw, _first_seen(spark, d))
    return rows.select("user_id", "basket_no", _listed(rows, "items"))


# The same with all users as queries

for _name in (
    "tifu_neighbors_exact", "tifu_recommend", "tifu_delete_baskets", "tifu_add_baskets", "lsh_candidates", "tifu_recommend_lsh",
    "metrics_ndcg", "metrics_prf", "metrics_hit", "metrics_summary",
    "base_tifu_knn_euclid", "base_tifu_merge", "base_tifu_merge_future", "base_neighbor_frequency", "base_weighted_futures",
    "tifu_changed_users", "tifu_recommend_discrete", "metrics_summary_20", "metrics_ndcg_full",
):
    for_all(f"{_name}_all", _name)
