"""Pieces that the corpus operators share: durable cuts of lineage, Arrow mapping, and word patterns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Arrow's own allocators keep what batches held; the system's gives it back.
pa.set_memory_pool(pa.system_memory_pool())
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also touch accented letters)."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder and a cluster gets one beside its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        folder = tempfile.mkdtemp(prefix="palimpsest-") if local else f"{warehouse.rstrip('/')}/_checkpoints/{uuid.uuid4().hex}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_and_size(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, and how many rows there are, counted on the way."""
    seen = Observation()
    df = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, int(seen.get["n"])


def released() -> None:
    """Give the memory that a block took back to the system, where the C library knows how to."""
    if _TRIM is not None:
        _TRIM(0)


def map_tables(df: DataFrame, function: Callable[[pa.Table], pa.Table | None], schema: str, rows: int = 512) -> DataFrame:
    """Apply a function of Arrow tables to each partition, so many rows at a time, which bounds what a worker holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = function(pa.Table.from_batches([batch.slice(start, rows)]))
                if out is not None and out.num_rows:
                    yield from out.to_batches()
            released()

    return df.mapInArrow(run, schema)


#: Ids that a broadcast may hold: some tens of megabytes.
FEW = 1 << 19


def only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``wanted``, which has each id once.

    Counted first: if they are few the ids go to where the texts are, else both meet by id.
    """
    wanted, n = durable_and_size(wanted)
    return docs.join(F.broadcast(wanted) if n <= FEW else wanted, "doc_id", "left_semi")


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not in ``gone``, which is counted first: few go to where the rows are."""
    gone, n = durable_and_size(gone.select(key))
    return rows.join(F.broadcast(gone) if n <= FEW else gone, key, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own, the same whenever they are read, and the name of that column.

    Files are split alike each time they are scanned, so a scan's rows can be numbered as they come. Anything else, such
    as what comes out of a shuffle, is written to the shared folder first.
    """
    row = fresh(df, "row")
    try:
        df.select("_metadata.row_index").schema  # only what is read from files has it
    except AnalysisException:
        path = f"{shared_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
        names = [f"c{i}" for i in range(len(df.columns))]  # which a file can hold whatever the columns are called
        df.toDF(*names).write.parquet(path)
        df = df.sparkSession.read.parquet(path).toDF(*df.columns)
    return df.withColumn(row, F.monotonically_increasing_id()), row


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
