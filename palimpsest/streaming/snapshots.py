"""Continuous updates: micro-batches of changes lead from one snapshot of base and result to the next.

A snapshot is a folder of Parquet tables; it counts once its marker is written, so a batch that runs again finds it done.
Of older snapshots only the last is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.held import held
from palimpsest.operators.baskets import BasketParams
from palimpsest.operators.sessions import SessionParams
from palimpsest.plans import changes as C
from palimpsest.plans.incremental import BasketState, SessionState, update_basket_state, update_session_state


class Snapshots:
    """Numbered snapshots of named tables under a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = spark._jvm.org.apache.hadoop.fs.Path

    def latest(self) -> int | None:
        """The number of the last complete snapshot."""
        if not self.files.exists(self.path(self.folder)):
            return None
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))]
        done = [int(n) for n in names if n.isdigit() and self.files.exists(self.path(f"{self.folder}/{n}/_DONE"))]
        return max(done, default=None)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        number = self.latest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{number}/{name}")

    def write(self, number: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{number}/{name}")
        self.files.create(self.path(f"{self.folder}/{number}/_DONE"), True).close()
        for status in self.files.listStatus(self.path(self.folder)):
            name = status.getPath().getName()
            if name.isdigit() and int(name) < number - 1:
                self.files.delete(status.getPath(), True)


def follow(stream: DataFrame, snapshots: Snapshots, step: Callable[[Snapshots, DataFrame], dict[str, DataFrame]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``step`` on each micro-batch: it gets the last snapshot and the batch, and gives the next one's tables."""

    def batch(df: DataFrame, batch_id: int) -> None:
        number = batch_id + 1
        last = snapshots.latest()
        if last is not None and last >= number:
            return
        snapshots.write(number, **step(snapshots, df))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def basket_step(recommend: Callable[[DataFrame], DataFrame]) -> Callable[[Snapshots, DataFrame], dict[str, DataFrame]]:
    """A step over basket events: insertions go behind a user's baskets, deletions renumber, and the result and its delta follow."""

    def step(snapshots: Snapshots, events: DataFrame) -> dict[str, DataFrame]:
        baskets = snapshots.read("baskets")
        rows = events.select(F.col("customerId").alias("user_id"), F.col("orderId").alias("basket_no"), F.col("basket").alias("items"), "isDeletion")
        gone, more = rows.filter("isDeletion"), rows.filter("NOT isDeletion").drop("isDeletion")
        if not gone.isEmpty():
            baskets = C.delete_baskets(baskets, gone)
        if not more.isEmpty():
            baskets = C.add_baskets(baskets, more)
        result = recommend(baskets)
        return {"baskets": baskets, "result": result, "delta": C.delta(snapshots.read("result"), result)}

    return step


def click_step(model: Callable[[DataFrame], DataFrame]) -> Callable[[Snapshots, DataFrame], dict[str, DataFrame]]:
    """A step over changes of clicks ``session_id, item_id, ord, diff``."""

    def step(snapshots: Snapshots, batch: DataFrame) -> dict[str, DataFrame]:
        clicks = C.apply(snapshots.read("clicks"), batch)
        result = model(clicks)
        return {"clicks": clicks, "result": result, "delta": C.delta(snapshots.read("result"), result)}

    return step


def session_step(params: SessionParams, n_total: int) -> Callable[[Snapshots, DataFrame], dict[str, DataFrame]]:
    """A step over changes of clicks ``session_id, item_id, ord, diff`` that computes only what they reach.

    The snapshot has all tables of a ``SessionState``; changes of one batch count at once, whatever their order.
    """

    def step(snapshots: Snapshots, batch: DataFrame) -> dict[str, DataFrame]:
        state = SessionState(*(snapshots.read(name) for name in SessionState.__dataclass_fields__))
        new, affected = update_session_state(state, batch, params, n_total)
        old, again = (x.result.join(affected, "session_id", "left_semi").select(*x.result.columns) for x in (state, new))
        return vars(new) | {"delta": C.delta(old, again)}

    return step


def recommendation_step(queries: Callable[[DataFrame], DataFrame], params: BasketParams) -> Callable[[Snapshots, DataFrame], dict[str, DataFrame]]:
    """A step over basket events that computes only what they reach; the snapshot has all tables of a ``BasketState``.

    Of a batch, deletions go first, each naming a basket by its number in the snapshot; insertions follow, in the order of
    their own numbers, and an event that a batch has twice counts once. ``queries`` gives the query users of the baskets.
    """

    def step(snapshots: Snapshots, events: DataFrame) -> dict[str, DataFrame]:
        state = BasketState(*(snapshots.read(name) for name in BasketState.__dataclass_fields__))
        rows = events.select(F.col("customerId").alias("user_id"), F.col("orderId").alias("basket_no"), F.col("basket").alias("items"), "isDeletion").distinct()
        gone, more = held(rows.filter("isDeletion").drop("isDeletion")), held(rows.filter("NOT isDeletion").drop("isDeletion"))
        new, affected = update_basket_state(state, queries(state.baskets), params, gone, more)
        old, again = (x.result.join(affected, "user_id", "left_semi").select(*x.result.columns) for x in (state, new))
        return vars(new) | {"delta": C.delta(old, again)}

    return step
