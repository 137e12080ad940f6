"""The same queries in DuckDB SQL, from common parts. Tables are the star schema's views."""

from __future__ import annotations

from palimpsest.functions.lsh import Family

CLICKS = """clicks AS (
  SELECT l_orderkey AS session_id, l_partkey AS item_id, epoch(l_shipdate)::BIGINT AS ord, l_linenumber AS line, l_suppkey AS supplier FROM lineitem
), base_history AS (SELECT session_id, item_id, ord FROM clicks WHERE session_id % 20 <> 0
), evolving AS (
  SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY ord, line, item_id, supplier) AS position FROM clicks WHERE session_id % 20 = 0
)"""
WHOLE = "history AS (SELECT * FROM base_history)"
TOTAL = "total AS (SELECT count(*) AS n FROM base_history)"


def sessions(m: int, k: int, history: str = WHOLE, evolving: str = "evo AS (SELECT * FROM evolving)") -> str:
    """Every stage of the session model, as common table expressions."""
    return f"""{CLICKS}, {TOTAL}, {history}, {evolving},
recency AS (SELECT session_id, max(ord) AS max_ord FROM history GROUP BY session_id),
pairs AS (SELECT DISTINCT h.item_id, h.session_id, r.max_ord FROM history h JOIN recency r USING (session_id)),
idx AS (SELECT item_id, session_id, max_ord FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY max_ord DESC, session_id) <= {m}),
idf AS (SELECT item_id, ln((SELECT n FROM total)::DOUBLE / count(DISTINCT session_id)) AS idf FROM pairs GROUP BY item_id),
weights AS (SELECT session_id, item_id, sum(position)::BIGINT AS w FROM evo GROUP BY session_id, item_id),
lens AS (SELECT session_id, count(DISTINCT item_id) AS length FROM evo GROUP BY session_id),
cand AS (SELECT DISTINCT w.session_id, i.session_id AS hist_id, i.max_ord FROM weights w JOIN idx i USING (item_id)),
kept AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY max_ord DESC, hist_id) <= {m}),
sims AS (
  SELECT c.session_id, c.hist_id, sum(w.w)::BIGINT AS sum_w, any_value(l.length) AS length, min(CASE WHEN l.length - w.w + 1 > 0 THEN l.length - w.w + 1 ELSE 1 END)::BIGINT AS match_position
  FROM kept c JOIN idx i ON i.session_id = c.hist_id JOIN weights w ON w.session_id = c.session_id AND w.item_id = i.item_id JOIN lens l ON l.session_id = c.session_id
  GROUP BY c.session_id, c.hist_id
),
near AS (SELECT *, sum_w::DOUBLE / length AS similarity FROM sims QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sum_w DESC, hist_id) <= {k}),
scored AS (
  SELECT session_id, item_id, raw * idf AS score FROM (
    SELECT n.session_id, i.item_id, sum(CASE WHEN n.match_position < 100 THEN (10 - n.match_position) * n.sum_w ELSE 0 END)::DOUBLE / (10 * any_value(n.length)) AS raw
    FROM near n JOIN idx i ON i.session_id = n.hist_id GROUP BY n.session_id, i.item_id
  ) JOIN idf USING (item_id)
),
current AS (SELECT session_id, arg_max(item_id, position) AS current FROM evo GROUP BY session_id),
served AS (
  SELECT s.session_id, s.item_id, row_number() OVER (PARTITION BY s.session_id ORDER BY floor(s.score * 1e9 + 0.3) DESC, s.item_id) AS r
  FROM scored s JOIN current c USING (session_id) WHERE s.item_id <> c.current
)"""


BASKETS = """lines AS (
  SELECT o_custkey AS user_id, o_orderkey AS order_key, o_orderdate AS order_date, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), interactions AS (SELECT DISTINCT user_id, item_id FROM lines
), all_baskets AS (
  SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY order_date, order_key) AS basket_no, item_id FROM (SELECT DISTINCT * FROM lines)
)"""


def tifu(baskets: str = "b AS (SELECT * FROM all_baskets)", size: int = 7, rb: float = 0.9, rg: float = 0.7) -> str:
    return f"""{BASKETS}, {baskets},
grp AS (SELECT *, (basket_no + {size - 1}) // {size} AS grp FROM b),
grp_n AS (SELECT user_id, grp, count(DISTINCT basket_no) AS n FROM grp GROUP BY user_id, grp),
gv AS (
  SELECT g.user_id, g.grp, g.item_id, sum(pow({rb}, {size} - ((g.basket_no - 1) % {size} + 1 + {size} - n.n)) / n.n) AS value
  FROM grp g JOIN grp_n n ON n.user_id = g.user_id AND n.grp = g.grp GROUP BY g.user_id, g.grp, g.item_id
),
last_grp AS (SELECT user_id, max(grp) AS g FROM grp GROUP BY user_id),
uv AS (SELECT v.user_id, v.item_id, sum(pow({rg}, l.g - v.grp) / l.g * v.value) AS value FROM gv v JOIN last_grp l ON l.user_id = v.user_id GROUP BY v.user_id, v.item_id)"""


def nearest(k: int, queries: str = "user_id % 10 = 0", candidates: str = "") -> str:
    return f"""sizes AS (SELECT user_id, count(*) AS size FROM uv GROUP BY user_id),
inter AS (SELECT a.user_id, c.user_id AS other_id, count(*) AS shared FROM uv a JOIN uv c ON a.item_id = c.item_id AND a.user_id <> c.user_id WHERE a.{queries} GROUP BY a.user_id, c.user_id),
jac AS (SELECT t.user_id, t.other_id, t.shared::DOUBLE / (x.size + y.size - t.shared) AS jaccard FROM inter t JOIN sizes x ON x.user_id = t.user_id JOIN sizes y ON y.user_id = t.other_id {candidates}),
nn AS (SELECT * FROM jac QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY jaccard DESC, other_id) <= {k})"""


def merged(alpha: float) -> str:
    return f"""nn_n AS (SELECT user_id, count(*) AS n FROM nn GROUP BY user_id),
rec AS (
  SELECT user_id, item_id, sum(value) AS value FROM (
    SELECT u.user_id, u.item_id, {alpha} * u.value AS value FROM uv u JOIN nn_n USING (user_id)
    UNION ALL
    SELECT n.user_id, u.item_id, {1 - alpha} * sum(u.value) / any_value(c.n) FROM nn n JOIN nn_n c ON c.user_id = n.user_id JOIN uv u ON u.user_id = n.other_id GROUP BY n.user_id, u.item_id
  ) GROUP BY user_id, item_id
)"""


def signatures(permutations: int, seed: int) -> str:
    rows = ", ".join(f"({j}, {a}, {b})" for j, (a, b) in enumerate(Family(permutations, seed).coefficients()))
    return f"""fam(j, a, b) AS (VALUES {rows}),
sig AS (SELECT user_id, j, min((a * (item_id % 2147483647) + b) % 2147483647) AS h FROM (SELECT DISTINCT user_id, item_id FROM b), fam GROUP BY user_id, j)"""


def bands(n: int, rows: int) -> str:
    return f"band AS (SELECT user_id, (j // {rows})::INT AS band, string_agg(h::VARCHAR, ',' ORDER BY j) AS key FROM sig WHERE j < {n * rows} GROUP BY user_id, j // {rows})"


def split_baskets() -> str:
    """All baskets but each user's last, which is the truth."""
    return """ends AS (SELECT user_id, max(basket_no) AS last FROM all_baskets GROUP BY user_id),
b AS (SELECT a.* FROM all_baskets a JOIN ends e ON e.user_id = a.user_id WHERE a.basket_no < e.last),
truth AS (SELECT DISTINCT a.user_id, a.item_id FROM all_baskets a JOIN ends e ON e.user_id = a.user_id WHERE a.basket_no = e.last)"""
