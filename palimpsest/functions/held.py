"""Frames that are kept: few rows as a table of the plan's own, many in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that the driver holds at most.
MOST = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it isn't set a temporary one if the master is local, else one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        folder = tempfile.mkdtemp(prefix="palimpsest-") if spark.sparkContext.master.startswith("local") else f"{warehouse.rstrip('/')}/_checkpoints/{uuid.uuid4().hex}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Computed once, and kept where a lost executor doesn't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Computed once, as compressed files in the shared folder; shuffles that led there are let go of."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark deletes shuffles that no plan refers to any more
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, most: int = MOST) -> DataFrame:
    """The same rows, computed once. Up to ``most`` rows are handed to the plans that use them, which Spark then
    broadcasts by their known size; more are written to the shared folder.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return stored(df)
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with their place, from 0, in the order of a key that has no repeats. No one task sees all rows."""
    placed = durable(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    both = placed.withColumn("_in", inside).join(sizes.select("_part", before.alias("_before")), "_part")
    return both.select(*df.columns, (F.col("_in") + F.col("_before")).cast("bigint").alias(name))
