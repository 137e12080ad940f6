"""Exact top-k by inner product with a Voronoi join.

Pivots, a bounded sample, cut the data into groups. A summary of each group - its size and radius - bounds the score of
any of its vectors for a query: ``q.p + |q| r``. A query first meets its own group, which gives a score that its result
must reach; then it goes only to groups whose bound reaches that. A large group (a third of all vectors may be equal) is
cut into cells of bounded size, each solved by itself, and the best k of each cell are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import durable, map_tables

#: Pivots at most, drawn by hash of their id; and vectors in a cell, about.
PIVOTS = 128
CELL = 2048
SCALE = 1024
PARTIAL = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x). Vectors that are null, or hold null or non-finite components, go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """Each query's k highest integer inner products with all other rows: ``query_id, rank, vec_id, score``.

    Ties go to the smaller id; with fewer candidates all are returned. ``is_query`` is a condition on ``vec_id``. Rows
    without id, and vectors that are null or hold null or non-finite components, take no part; a shorter vector counts as
    if zeros followed; an empty vector scores 0. A candidate that repeats an id is a row of its own, and a query is any
    row but those of its own id; queries that repeat an id are one. Scores are exact below 2^63 and an error beyond.
    """
    data = durable(quantised(vectors, scale))
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").toArrow()  # at most PIVOTS rows
    if not picked.num_rows:
        return data.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0L AS score").limit(0)
    width = max(1, data.agg(F.max(F.size("v"))).first()[0])
    pivots = np.unique(_matrix(picked["v"], width).astype(np.float64), axis=0)

    def place(rows: pa.Table) -> pa.Table:
        v = _matrix(rows["v"], width).astype(np.float64)
        far = ((v**2).sum(1)[:, None] - 2 * v @ pivots.T) + (pivots**2).sum(1)
        near = far.argmin(1)
        return rows.append_column("pivot", pa.array(near, pa.int32())).append_column("away", pa.array(np.linalg.norm(v - pivots[near], axis=1)))

    placed = durable(map_tables(data, place, "vec_id long, v array<long>, pivot int, away double", CELL))
    summary = {r.pivot: (r.n, r.radius) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # a row a pivot
    cells = {p: -(-n // CELL) for p, (n, _) in summary.items()}
    n_cells = F.create_map(*(F.lit(x) for item in cells.items() for x in item))
    cell = F.concat_ws(":", "pivot", F.pmod(F.xxhash64("vec_id", F.lit("cell")), n_cells[F.col("pivot")]))
    celled = placed.select(cell.alias("cell"), "vec_id", "v")
    queries = placed.filter(is_query).dropDuplicates(["vec_id"])

    def spread(asks: DataFrame) -> DataFrame:
        """Queries with a list of pivots to each cell of these."""
        each = asks.select("vec_id", "v", F.explode("pivots").alias("pivot"))
        part = F.explode(F.sequence(F.lit(0).cast("long"), (n_cells[F.col("pivot")] - 1).cast("long")))
        return each.select("vec_id", "v", "pivot", part.alias("part")).select(F.concat_ws(":", "pivot", "part").alias("cell"), "vec_id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        q, x = _matrix(left["v"], width), _matrix(right["v"], width)
        ids, of = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(of), 512):
            scores = _products(q[start : start + 512], x)
            for query, row in zip(of[start : start + 512], scores, strict=True):
                other = ids != query
                mine, at = row[other], ids[other]
                best = np.argsort(-mine, kind="stable")[:k]
                out.append((np.full(len(best), query), at[best], mine[best]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    def solved(asks: DataFrame) -> DataFrame:
        return spread(asks).groupBy("cell").cogroup(celled.groupBy("cell")).applyInArrow(solve, PARTIAL)

    # Its own group gives each query a score to reach, if the group has k others.
    own = durable(solved(queries.select("vec_id", "v", F.array("pivot").alias("pivots"))))
    reach = own.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.when(F.size("s") >= k, F.element_at("s", k)).alias("reach"))
    asks = queries.select("vec_id", "v", "pivot").join(reach, "vec_id", "left")

    def route(rows: pa.Table) -> pa.Table:
        q = _matrix(rows["v"], width).astype(np.float64)
        known = np.array([p for p in sorted(summary)])
        radius = np.array([summary[p][1] for p in known])
        # Room for rounding: a bound that is a little too high only sends a query to a group too many.
        bound = q @ pivots[known].T + np.linalg.norm(q, axis=1)[:, None] * radius
        bound += 1e-9 * np.abs(bound) + 1
        least = rows["reach"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        least = np.where(np.isnan(least), -np.inf, least)
        goes = (bound >= least[:, None]) & (known[None, :] != rows["pivot"].to_numpy()[:, None])
        return pa.table([rows["vec_id"], rows["v"], pa.array([known[g].tolist() for g in goes], pa.list_(pa.int32()))], names=["vec_id", "v", "pivots"])

    rest = solved(map_tables(asks, route, "vec_id long, v array<long>, pivots array<int>"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = array.offsets.to_numpy(), array.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(array), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where no sum can pass 2^53, else in integers of any size."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 2**63:
        raise OverflowError("an inner product passes 64 bits")
    return exact.astype(np.int64)


def op9(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
