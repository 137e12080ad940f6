"""The logical inputs, from the star-schema tables and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVERY = 20


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, item_id, ord, line, supplier``: an order is a session; its lines are clicks at the day of shipment."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 86400
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item_id"), day.alias("ord"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).filter(F.col("session_id") % EVERY != 0).select("session_id", "item_id", "ord")


def evolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, item_id, position`` of every twentieth session."""
    order = W.partitionBy("session_id").orderBy("ord", "line", "item_id", "supplier")
    rows = clicks(spark, sf_dir).filter(F.col("session_id") % EVERY == 0)
    return rows.withColumn("position", F.row_number().over(order)).select("session_id", "item_id", "position")


def event_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, item_id, ord`` from the event log: a user's day is a session, the property k the item."""
    day = F.date_format("ts", "yyyyMMdd").cast("bigint")
    item = F.get_json_object("props", "$.k").cast("bigint")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return _read(spark, sf_dir, "events").select((F.col("user_id") * 100_000_000 + day).alias("session_id"), item.alias("item_id"), second.alias("ord")).dropna()


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, order_key, order_date, item_id``."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("order_date"), F.col("l_partkey").alias("item_id"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, basket_no, items``: a customer's orders in time, with the sorted distinct parts of each."""
    grouped = order_lines(spark, sf_dir).groupBy("user_id", "order_key", "order_date").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    number = F.row_number().over(W.partitionBy("user_id").orderBy("order_date", "order_key"))
    return grouped.select("user_id", number.alias("basket_no"), "items")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select("user_id", "item_id").distinct()
