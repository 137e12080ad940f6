"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Only rows whose length *and* beginning occur again have their whole text hashed. Which beginnings survive is told to the
scan by a bitmap of fixed size, so no text is ever shuffled: a false positive costs one hash and decides nothing. Groups
are aggregated before the shuffle and joined back by hash, and adaptive execution splits the join of a huge group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import ascii_lower, durable, numbered, without

#: Characters that the second level looks at.
PREFIX = 256
#: Bits of the map of surviving beginnings: 4 MB, whatever the input.
BITS = 1 << 25


def copies(docs: DataFrame, all_digests: bool = False, row: str | None = None) -> DataFrame:
    """Every row with its group of equal texts: ``doc_id, row, n_chars, prefix_hash, text_sha256, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z; a null text equals an empty one. The row with the largest
    doc_id of a group is kept; a null id is smaller than any; among rows that repeat that id exactly one is kept. ``row``
    tells repeated rows apart: it is the column so named by the argument, else a number of this result's own.
    ``text_sha256`` is null where refinement never read the whole text, unless ``all_digests``. Texts of any length are
    compared whole. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), text.alias("text"))
    n_chars, prefix_hash = _prefix_columns()
    counted = docs.select(n_chars, prefix_hash).groupBy("n_chars", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    lengths = counted.groupBy("n_chars").agg(F.sum("n").alias("n")).filter("n > 1").select("n_chars")
    begins = counted.join(lengths, "n_chars", "left_semi").filter("n > 1")
    slot = F.pmod(F.xxhash64("n_chars", "prefix_hash"), F.lit(BITS))
    bitmap = (
        begins.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    position = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    alive = F.coalesce(F.getbit(byte.cast("long"), (position % 8).cast("int")) == 1, F.lit(False))
    rows = (
        docs.select("doc_id", "row", "text", n_chars, prefix_hash)
        .withColumn("slot", slot)
        .withColumn("page", F.bitmap_bucket_number("slot"))
        .join(F.broadcast(bitmap), "page", "left")  # at most BITS / 8 bytes
        .withColumn("alive", alive)
    )
    whole = F.sha2(F.encode(ascii_lower(F.col("text")), "UTF-8"), 256)
    rows = durable(
        rows.select(
            "doc_id", "row", "n_chars", "prefix_hash", "alive",
            (whole if all_digests else F.when(F.col("alive"), whole)).alias("text_sha256"),
        )
    )
    key = F.when(F.col("alive"), F.col("text_sha256")).otherwise(F.concat(F.lit("row "), F.col("row"))).alias("key")
    groups = (
        rows.filter("alive")
        .groupBy(F.col("text_sha256").alias("key"))
        .agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    joined = rows.withColumn("key", key).join(groups, "key", "left")
    return joined.select(
        "doc_id", "row", "n_chars", "prefix_hash", "text_sha256",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def _prefix_columns() -> tuple[Column, Column]:
    n_chars = F.length("text").cast("long").alias("n_chars")
    return n_chars, F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX))).alias("prefix_hash")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, as ``copies`` chooses; all columns stay, whatever their names.

    Rows are told apart by where they stand, so null and repeated ids make no difference to what is a copy.
    """
    rows, row = numbered(docs)
    gone = copies(rows, row=row).filter("NOT kept").select(F.col("row").alias(row))
    return without(rows, row, gone).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return copies(docs, all_digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
