"""Times the headline queries, and updates against full recomputation, and prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of threads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "ib_jaccard", "vs_neighbors_top_k", "vs_item_scores", "vs_recommend_top20", "vs_prefix_replay", "vs_forget_clicks",
    "tifu_user_vectors", "tifu_recommend", "tifu_recommend_lsh", "metrics_summary", "base_vsknn_scores", "base_tifu_knn_euclid",
)


def run(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def updates(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds to compute all results, and to have those that 1, 10 and 100 changes reach, with how many keys they are."""
    from palimpsest.functions.held import held
    from palimpsest.plans import changes as C
    from palimpsest.plans import incremental as inc
    from palimpsest.plans.queries import SESSIONS, SHOP
    from palimpsest.sources import tables

    history, evolving = tables.history(spark, sf_dir).persist(), tables.evolving(spark, sf_dir).persist()
    interactions, baskets = tables.interactions(spark, sf_dir).persist(), tables.baskets(spark, sf_dir).persist()
    total, users = history.count(), held(baskets.select("user_id").distinct().filter("user_id % 20 = 0"))
    for df in (evolving, interactions):
        df.count()
    out = {
        "sessions_full": run(inc.SessionState.build(history, evolving, SESSIONS, total).result),
        "items_full": run(inc.ItemState.build(interactions).result),
        "baskets_full": run(inc.BasketState.build(baskets, users, SHOP).result),
    }
    sessions, items, shop = inc.SessionState.build(history, evolving, SESSIONS, total).saved(), inc.ItemState.build(interactions).saved(), inc.BasketState.build(baskets, users, SHOP).saved()
    gone_users = interactions.select("user_id").distinct().orderBy("user_id")
    steps = {
        "sessions": lambda n: inc.update_session_state(sessions, C.deletions(history.orderBy("session_id", "item_id", "ord").limit(n)), SESSIONS, total),
        "items": lambda n: inc.update_item_state(items, C.forget_users(interactions, gone_users.limit(n))),
        "baskets": lambda n: inc.update_basket_state(shop, users, SHOP, gone=baskets.filter("basket_no = 1").orderBy("user_id").limit(n)),
    }
    for name, step in steps.items():
        for n in (1, 10, 100):
            began = time.perf_counter()
            new, affected = step(n)
            key = affected.withColumnRenamed("item_id", "item_a")
            held(new.result.join(key, key.columns, "left_semi"))
            out[f"{name}_{n}"] = time.perf_counter() - began
            out[f"{name}_{n}_keys"] = affected.count()
    return out


#: Seconds after which no further protocol is begun.
ENOUGH = 400


def workloads(spark: SparkSession, sf_dir: str, began: float) -> dict[str, float]:
    """Mean microseconds of the measurement protocols, on grids scaled down: two steps of each, as far as time goes."""
    from statistics import mean

    from palimpsest.plans import workloads as w
    from palimpsest.plans.queries import SESSIONS, SHOP
    from palimpsest.sources import tables

    history, evolving, baskets = (f(spark, sf_dir).persist() for f in (tables.history, tables.evolving, tables.baskets))
    protocols = {}
    for kind in ("deletion", "insertion", "mixed"):
        protocols[f"vs_{kind}"] = lambda kind=kind: w.click_changes(kind, history, evolving, SESSIONS, 20, 10, 100, w.SEEDS[0], steps=2)
        protocols[f"tifu_{kind}"] = lambda kind=kind: w.basket_changes(kind, baskets, SHOP, 20, 10, 100, w.SEEDS[0], steps=2)
    protocols["vs_refit"] = lambda: w.session_refits(history, evolving, 100, 2)
    protocols["tifu_refit"] = lambda: w.basket_refits(baskets, 100, 2, k=20)
    return {name: mean(r["latency"] for r in rows()) for name, rows in protocols.items() if time.perf_counter() - began < ENOUGH}


def main() -> None:
    began = time.perf_counter()
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from palimpsest.plans.queries import QUERIES

    run(QUERIES["ib_user_counts"](spark, sf_dir))  # compiles and warms up
    seconds = {name: round(run(QUERIES[name](spark, sf_dir)), 3) for name in HEADLINE}
    changes = {k: round(v, 3) for k, v in updates(spark, sf_dir).items()}
    protocols = {k: round(v) for k, v in workloads(spark, sf_dir, began).items()}
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "updates": changes, "workloads_micros": protocols, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
