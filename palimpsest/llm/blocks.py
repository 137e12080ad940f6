"""Blocks of documents, and questions that blocks ask of the whole corpus.

A block is about a megabyte of consecutive documents, packed and compressed, with an id of its own. An operator that
needs facts about the whole corpus for each word or passage of a document works in rounds: every block sends its
*distinct* keys, packed as arrays, to buckets chosen by the key (``ask``); a bucket sees all blocks that hold a key and
answers each of them (``answer``); block and answers meet again by block id (``resolve``).

A key that fills a third of the corpus arrives at its bucket once for each block at most, so no key makes a hot group,
and texts move once per round as compressed blobs. Blocks are kept in the shared folder, so their ids stay valid when
executors are lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.llm.shared import durable, partitions, released

#: Bytes of text in a block, unless a single document has more.
BLOCK_BYTES = 1 << 20
BLOCK_SCHEMA = "block string, blob binary, n_bytes long"


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


@dataclass
class Blocks:
    """Durable blocks, how many bytes of text they hold in all, and how many blocks there are."""

    df: DataFrame
    n_bytes: int
    n_blocks: int

    def buckets(self, bytes_each: int = 8 << 20) -> int:
        """Enough buckets that one holds the keys of about ``bytes_each`` bytes of text, and that all tasks have some."""
        return max(2 * partitions(self.df.sparkSession), -(-self.n_bytes // bytes_each), 1)


def cut(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of BLOCK_SCHEMA that hold all rows of ``docs``; one column must be named ``text``. Rows keep their order within a
    partition, so a scan gives the same blocks, of the same ids, each time it is read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            blob = pack(pa.concat_tables(held).combine_chunks())
            out = pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{seq}-{hashlib.sha256(blob).hexdigest()[:16]}"]), pa.array([blob], pa.binary()), pa.array([size], pa.int64())],
                ["block", "blob", "n_bytes"],
            )
            seq, size = seq + 1, 0
            held.clear()
            return out

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            lengths = rows["text"].combine_chunks().fill_null("")
            ends = np.cumsum(pa.compute.binary_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64)) if rows.num_rows else []
            start = 0
            while start < rows.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(rows.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= block_bytes or start < rows.num_rows:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """All rows of ``docs`` in durable blocks; see ``cut``."""
    seen = Observation()
    df = cut(docs, block_bytes).observe(seen, F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_blocks"))
    df = durable(df)
    got = seen.get
    return Blocks(df, int(got["n_bytes"] or 0), int(got["n_blocks"] or 0))


def ask(blocks: Blocks, emit: Callable[[str, pa.Table, pa.Table | None], pa.Table], columns: str, answers: DataFrame | None = None) -> DataFrame:
    """Rows that each block emits; ``emit`` gets its id, its documents and, where there are some, its answers."""
    return _resolve(blocks, answers, emit, columns)


def resolve(blocks: Blocks, answers: DataFrame, finish: Callable[[str, pa.Table, pa.Table], pa.Table], columns: str) -> DataFrame:
    """Rows made of each block's documents and its answers; ``answers`` must have a row for every block."""
    return _resolve(blocks, answers, finish, columns)


def answer(asked: DataFrame, reply: Callable[[pa.Table], pa.Table], columns: str) -> DataFrame:
    """Each bucket's rows, from all blocks, go through ``reply``."""
    return asked.groupBy("bucket").applyInArrow(reply, columns)


def _resolve(blocks: Blocks, answers: DataFrame | None, function: Callable, columns: str) -> DataFrame:
    df = blocks.df.select("block", "blob")
    if answers is None:

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                    out = function(block, unpack(blob.as_buffer()), None)
                    if out.num_rows:
                        yield from out.to_batches()
                    del out
                    released()

        return df.mapInArrow(each, columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [function(block, unpack(blob.as_buffer()), right) for block, blob in zip(left["block"].to_pylist(), left["blob"], strict=True)]
        released()
        return pa.concat_tables(parts)

    return df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, columns)
