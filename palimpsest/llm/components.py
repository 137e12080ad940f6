"""Connected components of a graph of links, without collecting any of it.

Each task first reduces the links it has to a forest. What is left goes through rounds: every component hooks onto its
neighbour of least priority, pointers are shortened, and links inside one component disappear. Priorities are hashes, so
no order of ids makes long chains. When the links left are so few that one task holds them, it ends the matter by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import durable, durable_and_size

#: Links that one task may hold: 16 MB of ids.
IN_ONE_TASK = 1 << 20


def contract(labels: DataFrame | None, links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame | None:
    """``id, comp`` after merging the components that ``links`` (``a, b``: two ids) join.

    Labels of comp are ids themselves. Only ids whose component has another's name have a row; None stands for no rows.
    """
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    ends = named(named(ends, "x", labels), "y", labels).filter("x <> y")
    ends, n = durable_and_size(ends.mapInArrow(_forest, "x long, y long"))
    while n:
        if n <= in_one_task:
            parents, n = durable(ends.coalesce(1).mapInArrow(_forest, "x long, y long").select("x", F.col("y").alias("to"))), 0
        else:
            both = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y")))
            hooks = both.groupBy("x").agg(F.min(F.struct(F.xxhash64("y").alias("p"), F.col("y").alias("c"))).alias("best"))
            own = F.struct(F.xxhash64("x").alias("p"), F.col("x").alias("c"))
            hooks = hooks.filter(F.col("best") < own).select(F.col("x").alias("id"), F.col("best.c").alias("comp"))
            short = named(hooks, "comp", hooks)
            parents = durable(named(short, "comp", short).select(F.col("id").alias("x"), F.col("comp").alias("to")))
        names = parents.select(F.col("x").alias("id"), F.col("to").alias("comp"))
        labels = names if labels is None else durable(named(labels, "comp", names).unionByName(names))
        if n:
            ends, n = durable_and_size(named(named(ends, "x", names), "y", names).filter("x <> y").mapInArrow(_forest, "x long, y long"))
    return labels


def named(rows: DataFrame, column: str, labels: DataFrame | None) -> DataFrame:
    """Rows with the ids of a column replaced by their components' names."""
    if labels is None:
        return rows
    of = labels.select(F.col("id").alias("_of"), F.col("comp").alias("_name"))
    joined = rows.join(of, F.col(column) == F.col("_of"), "left")
    return joined.select(*(F.coalesce("_name", c).alias(c) if c == column else F.col(c) for c in rows.columns))


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``x, y`` of every million reduced to one from each id to the least that it reaches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= IN_ONE_TASK:
                yield _stars(held)
                held = []
    if held:
        yield _stars(held)


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, ends = np.unique(np.concatenate([np.concatenate(c) for c in zip(*held, strict=True)]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        for side in (a, b):
            np.minimum.at(least, before[side], low)
            np.minimum.at(least, side, low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            break
    far = np.flatnonzero(least != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int64()), pa.array(ids[least[far]], pa.int64())], ["x", "y"])
