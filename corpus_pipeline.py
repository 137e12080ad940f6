"""A corpus pipeline: quality, exact dedup, near dedup, mixing to target weights, and token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which has been written and read again.
All but the last return the columns of documents, and columns of any name besides. Rows are told apart by where they stand
in the files, so each row is judged by its own text: null and repeated ids, and ties, change nothing. A null text counts as
an empty one, texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact, mixing, near, pieces, quality
from palimpsest.llm.shared import durable, fresh, numbered, removed, shared_folder, without

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Labels come from the table ``labels``, and go by id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows, row = numbered(docs)
    judged = quality.classify(rows, labels, F.col("source"), F.col("lang"), row=row)
    return without(rows, row, judged.filter("NOT accepted").select(F.col("row").alias(row))).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays: that of the largest id, a null id being least."""
    return exact.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id, a null id being last. Texts without words stay."""
    rows, row = numbered(docs)
    groups = near.near_groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    members = durable(groups.join(ids, "row"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    stays = members.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", F.col("first.row").alias("stays"))
    gone = members.join(stays, "component").filter("row <> stays").select(F.col("row").alias(row))
    return without(rows, row, gone).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, row = numbered(docs)
    copies = mixing.mix(rows, row=row).filter("copies > 0")
    again = fresh(rows, "copies")
    taken = rows.join(copies.select(F.col("row").alias(row), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(again)), row)
    return taken.withColumn(again, F.explode(again)).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text that they decode to."""
    return pieces.round_trip(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: The classifier is fitted, which SQL can't express; the pipeline is tested stage by stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``. What a stage wrote goes when the next one has written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            removed(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
