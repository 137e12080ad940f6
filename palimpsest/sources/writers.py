"""Sinks: prediction lines, vector lines, vocabularies, measurements and basket events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction_line(recommended: str = "recommended", observed: str = "observed") -> Column:
    """``rec,rec,...;obs,obs,...`` from two arrays."""

    def listed(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ",")

    return F.concat_ws(";", listed(recommended), listed(observed))


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select(prediction_line().alias("value")).write.mode("overwrite").text(path)


def vector_lines(vectors: DataFrame, prefix: str | None = None, digits: int | None = None) -> DataFrame:
    """``user_id, line``: entries ``item:value`` in item order, joined by semicolons, after ``<prefix>-<user>-`` if one is given."""
    value = F.col("value") if digits is None else F.round("value", digits)
    entries = F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("i"), value.alias("v"))))
    line = F.array_join(F.transform(entries, lambda e: F.concat(e["i"].cast("string"), F.lit(":"), e["v"].cast("string"))), ";")
    head = F.concat(F.lit(f"{prefix}-"), F.col("user_id").cast("string"), F.lit("-")) if prefix else F.lit("")
    return vectors.groupBy("user_id").agg(line.alias("body")).select("user_id", F.concat(head, "body").alias("line"))


def vocabulary(baskets: DataFrame) -> DataFrame:
    return baskets.select(F.explode("items").alias("item_id")).distinct()


def write_vocabulary(baskets: DataFrame, path: str) -> None:
    vocabulary(baskets).withColumnRenamed("item_id", "itemId").orderBy("itemId").write.mode("overwrite").option("header", True).csv(path)


def write_measurements(spark, rows: Iterable[dict], path: str) -> None:
    """Rows of a bench - names, sizes, latencies, numbers of changed keys - as one CSV file with a header."""
    spark.createDataFrame(list(rows)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_basket_events(baskets: DataFrame, folder: str, deletion: bool = False) -> None:
    """Basket events in JSON, for a file stream to pick up."""
    event = baskets.select(F.col("user_id").alias("customerId"), F.col("basket_no").cast("int").alias("orderId"), F.col("items").alias("basket"), F.lit(deletion).alias("isDeletion"))
    event.write.mode("append").json(folder)
