"""Readers of click, basket and interaction logs, vectors and basket events, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLICK_FILE = "session_id BIGINT, item_id BIGINT, time DOUBLE"
BASKET_FILE = "user_id BIGINT, basket_no INT, raw_item BIGINT"
INTERACTION_FILE = "user_id BIGINT, item_id BIGINT"
BASKET_EVENT = "customerId BIGINT, orderId INT, basket ARRAY<BIGINT>, isDeletion BOOLEAN"
LARGEST_ORDER = 2**32 - 1


def clicks(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, item_id, ord`` from a tab-separated file with a header; malformed rows are dropped.

    Times are epoch seconds, rounded half away from zero and held within 32 unsigned bits.
    """
    rows = spark.read.schema(CLICK_FILE).options(sep="\t", header=True, mode="DROPMALFORMED").csv(path)
    order = F.least(F.greatest(F.round("time"), F.lit(0.0)), F.lit(float(LARGEST_ORDER))).cast("bigint")
    return rows.dropna().select("session_id", "item_id", order.alias("ord"))


def evolving(rows: DataFrame, shortest: int = 2, order: tuple[str, ...] = ("ord", "item_id")) -> DataFrame:
    """``session_id, item_id, position``: clicks numbered from 1 within their session; short sessions are left out."""
    whole = W.partitionBy("session_id")
    numbered = rows.withColumn("position", F.row_number().over(whole.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(whole))
    return numbered.filter(F.col("n") >= shortest).select("session_id", "item_id", "position")


def basket_rows(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, basket_no, raw_item`` from a comma-separated file with a header; a malformed row is an error."""
    return spark.read.schema(BASKET_FILE).options(header=True, mode="FAILFAST", enforceSchema=True).csv(path)


def parse_baskets(rows: DataFrame, offset: int = 1) -> DataFrame:
    """``user_id, basket_no, items``: sorted items, repeats kept, numbered from 0."""
    items = F.sort_array(F.collect_list(F.col("raw_item") - offset))
    return rows.groupBy("user_id", "basket_no").agg(items.alias("items"))


def encoded_baskets(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``user_id, basket_no, items``: the sorted distinct codes of each basket's items, numbered by user without gaps.

    ``rows`` has ``user_id, basket_no, item_id``, ``codes`` has ``item_id, code``; items without a code are left out.
    """
    grouped = rows.join(codes, "item_id").groupBy("user_id", "basket_no").agg(F.sort_array(F.collect_set("code")).alias("items"))
    number = F.row_number().over(W.partitionBy("user_id").orderBy("basket_no"))
    return grouped.select("user_id", number.alias("basket_no"), "items")


def number_of_items(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("raw_item").alias("num_items"))


def interactions(spark: SparkSession, path: str, cap: int = 500) -> DataFrame:
    """``user_id, item_id`` from a file with spaces between; ids count from 1 there and from 0 here.

    A user's first ``cap`` rows in file order are read, as a limit of the format; malformed rows are dropped.
    """
    rows = spark.read.schema(INTERACTION_FILE).options(sep=" ", mode="DROPMALFORMED").csv(path).dropna()
    # Ids that rise with the place in the file stand for file order.
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return first_interactions(placed, cap).select((F.col("user_id") - 1).alias("user_id"), (F.col("item_id") - 1).alias("item_id"))


def first_interactions(rows: DataFrame, cap: int, order: str = "place") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("user_id").orderBy(order))).filter(F.col("_n") <= cap).drop("_n")


def users(baskets: DataFrame) -> DataFrame:
    return baskets.select("user_id").distinct()


def partitioned(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows of one key in one of ``n`` partitions."""
    return rows.repartition(n, key)


def vectors(lines: DataFrame, prefix: str) -> DataFrame:
    """``user_id, item_id, value`` from lines ``<prefix>-<user>-<item>:<value>;...`` in the column ``value``."""
    parts = F.split("value", "-", 3)
    entry = F.explode(F.filter(F.split(F.element_at(parts, 3), ";"), lambda e: e != ""))
    rows = lines.filter(F.col("value").startswith(f"{prefix}-")).select(F.element_at(parts, 2).cast("bigint").alias("user_id"), entry.alias("entry"))
    pair = F.split("entry", ":")
    return rows.select("user_id", F.element_at(pair, 1).cast("bigint").alias("item_id"), F.element_at(pair, 2).cast("double").alias("value"))


def basket_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON basket events, one object to a line, from files that appear in a folder."""
    return spark.readStream.schema(BASKET_EVENT).json(folder)
