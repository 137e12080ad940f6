"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import WORD_PATTERN, durable, partitions

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """Add to each row the sums over all rows before it, in one global order or in one order for each ``within``.

    Rows are dealt by range of the order, so that a large group lies in many partitions; partition totals, of which
    there are few, give what came before.
    """
    within = within or []
    keys = [F.col(c) for c in within]
    named = df.withColumns({f"_add_{k}": v for k, v in sums.items()} | {f"_by_{i}": c for i, c in enumerate(order)})
    by = [F.col(f"_by_{i}") for i in range(len(order))]
    placed = durable(named.repartitionByRange(partitions(df.sparkSession), *keys, *by).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(*(F.sum(f"_add_{k}").alias(f"_sum_{k}") for k in sums))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *(F.col(c).alias(f"_of_{c}") for c in within), F.col("_part").alias("_of_part"),
        *(F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_off_{k}") for k in sums),
    )
    same = F.col("_part") == F.col("_of_part")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    own = {f"_in_{k}": F.coalesce(F.sum(f"_add_{k}").over(inside), F.lit(0)) for k in sums}
    out = placed.withColumns(own).join(parts, same)
    return out.select(*df.columns, *((F.col(f"_in_{k}") + F.col(f"_off_{k}")).alias(k) for k in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """For each source its size and target: ``source, source_size, target``. ``sizes`` has ``source`` and ``size``.

    Sources in code point order, null last, get the weights in turn and share ``share`` of all sizes by weight; none gets
    more than ``epochs`` times its size, and what it can't take goes to the others by weight until none is above.
    Where the water stands at level L, a source gets the less of its cap and L times its weight. Clamping any set of
    sources and sharing the rest by weight gives at most that level, and the right set gives just that; it is the
    sources of least cap for their weight. So L is the largest over the prefixes of that order.
    """
    if share > epochs:
        raise ValueError("the sources can't take more than all their epochs")
    sources = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running_totals(sources, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1).cast("long")})
    turn = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    caps = durable(ranked.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * epochs).alias("cap"), "rank"))
    whole = caps.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()  # two numbers
    words, weights_left = F.lit(float(whole.words or 0) * share) - F.col("caps_before"), F.lit(whole.weights or 0) - F.col("weights_before")
    filled = running_totals(caps, [F.col("cap") / F.col("weight"), F.col("rank")], {"caps_before": F.col("cap"), "weights_before": F.col("weight")})
    level = filled.agg(F.max(words / weights_left).alias("level")).first().level or 0.0  # one number
    return caps.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, row: str | None = None) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``, and ``row``,
    the column so named, if one is named.

    All documents of a source are taken whole as often as its target allows; for what remains, documents are taken once
    more in a seeded random order until the remainder is reached, to half the size of the last one. A null text has no
    words; a null source is a source; a null id sorts as an empty one; repeated rows count each by itself, and which of
    equal rows is taken once more doesn't matter; other columns are ignored; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    doc_id = F.col("doc_id").cast("long")
    kept = [] if row is None else [F.col(row).alias("row")]
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"))
    sizes = durable(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("lot"), *kept))
    rates = targets(sizes, weights, share, epochs).withColumnRenamed("source", "of_source")
    drawn = running_totals(sizes, [F.col("lot"), F.col("doc_id"), F.col("size")], {"before": F.col("size")}, ["source"])
    rated = drawn.join(rates, F.col("source").eqNullSafe(F.col("of_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    copies = (whole + F.when(2 * F.col("before") + F.col("size") < 2 * rest, 1).otherwise(0)).cast("long")
    return rated.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if kept else []))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS lot
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sizes GROUP BY source
), caps AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM sources
), filled AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::DOUBLE AS caps_before, coalesce(sum(weight) OVER b, 0)::DOUBLE AS weights_before
  FROM caps WINDOW b AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((a.words - caps_before) / (a.weights - weights_before)) AS level
  FROM filled, (SELECT sum(source_size)::DOUBLE * 1.5 AS words, sum(weight)::DOUBLE AS weights FROM caps) a
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM caps, level
), drawn AS (
  SELECT s.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY lot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * before + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn
"""
