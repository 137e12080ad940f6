import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import items as im
from palimpsest.sources import readers, writers
from palimpsest.streaming.snapshots import Snapshots, basket_step, click_step, follow


def test_clicks_are_rounded_and_bad_rows_dropped(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("SessionId\tItemId\tTime\n1\t10\t2.5\nx\t1\t1\n2\t20\t-2.5\n2\t30\t5000000000\n")
    got = sorted(tuple(r) for r in readers.clicks(spark, str(tmp_path / "c.tsv")).collect())
    assert got == [(1, 10, 3), (2, 20, 0), (2, 30, 4294967295)]


def test_evolving_sessions_have_two_clicks(spark):
    rows = spark.createDataFrame([(1, 5, 9), (1, 6, 3), (2, 7, 1)], "session_id long, item_id long, ord long")
    assert sorted(tuple(r) for r in readers.evolving(rows).collect()) == [(1, 5, 2), (1, 6, 1)]


def test_baskets(spark, tmp_path):
    (tmp_path / "b.csv").write_text("CUSTOMER_ID,ORDER_NUMBER,MATERIAL_NUMBER\n1,1,3\n1,1,2\n2,1,9\n1,1,2\n")
    rows = readers.basket_rows(spark, str(tmp_path / "b.csv"))
    assert sorted((r.user_id, r.basket_no, r["items"]) for r in readers.parse_baskets(rows).collect()) == [(1, 1, [1, 1, 2]), (2, 1, [8])]
    assert readers.number_of_items(rows).first()[0] == 9
    assert readers.users(rows).count() == 2
    (tmp_path / "bad.csv").write_text("CUSTOMER_ID,ORDER_NUMBER,MATERIAL_NUMBER\n1,one,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.basket_rows(spark, str(tmp_path / "bad.csv")).collect()


def test_interactions_are_capped_in_file_order(spark, tmp_path):
    (tmp_path / "i.txt").write_text("1 9\n1 8\n1 7\n2 1\nx y\n")
    got = sorted(tuple(r) for r in readers.interactions(spark, str(tmp_path / "i.txt"), cap=2).collect())
    assert got == [(0, 7), (0, 8), (1, 0)]


def test_vector_lines_round_trip(spark):
    rows = spark.createDataFrame([(7, 2, 0.5), (7, 1, 0.25), (8, 3, 1.0)], "user_id long, item_id long, value double")
    lines = writers.vector_lines(rows, "RECO").select(F.col("line").alias("value"))
    assert {r.value for r in lines.collect()} == {"RECO-7-1:0.25;2:0.5", "RECO-8-3:1.0"}
    assert sorted(map(tuple, readers.vectors(lines, "RECO").collect())) == sorted(map(tuple, rows.collect()))
    assert readers.vectors(lines, "USER").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([([1, 2], [3])], "recommended array<long>, observed array<long>")
    writers.write_predictions(rows, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first().value == "1,2;3"
    baskets = spark.createDataFrame([(1, 1, [5, 4])], "user_id long, basket_no int, items array<long>")
    writers.write_vocabulary(baskets, str(tmp_path / "v"))
    assert [r.itemId for r in spark.read.option("header", True).csv(str(tmp_path / "v")).collect()] == ["4", "5"]
    writers.write_measurements(spark, [{"name": "a", "micros": 5}], str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1


def test_basket_stream_inserts_and_deletes(spark, tmp_path):
    events, snaps = tmp_path / "events", Snapshots(spark, str(tmp_path / "snapshots"))
    events.mkdir()
    baskets = spark.createDataFrame([(1, 1, [5]), (1, 2, [6])], "user_id long, basket_no int, items array<long>")
    counted = lambda b: b.select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    snaps.write(0, baskets=baskets, result=counted(baskets))
    lines = [{"customerId": 1, "orderId": 1, "basket": [5], "isDeletion": True}, {"customerId": 2, "orderId": 1, "basket": [7, 6], "isDeletion": False}]
    (events / "a.json").write_text("\n".join(map(json.dumps, lines)))
    follow(readers.basket_events(spark, str(events)), snaps, basket_step(counted), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.user_id, r.basket_no, r["items"]) for r in snaps.read("baskets").collect()) == [(1, 1, [6]), (2, 1, [7, 6])]
    assert sorted(map(tuple, snaps.read("result").collect())) == [(6, 2), (7, 1)]
    assert sorted(map(tuple, snaps.read("delta").collect())) == [(5, 1, -1), (6, 1, -1), (6, 2, 1), (7, 1, 1)]


def test_click_stream(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "s"))
    clicks = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "session_id long, item_id long, ord long")
    snaps.write(0, clicks=clicks, result=im.popularity(clicks))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"session_id": 1, "item_id": 5, "ord": 1, "diff": -1}))
    stream = spark.readStream.schema("session_id long, item_id long, ord long, diff int").json(str(tmp_path / "in"))
    follow(stream, snaps, click_step(im.popularity), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, snaps.read("result").collect())) == [(6, 1)]
    assert snaps.latest() == 1
