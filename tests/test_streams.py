from __future__ import annotations

from pyspark.sql import functions as F

from shopstream.operators.rollup import rollup_query_day
from shopstream.streaming import streams


def write_events(spark, folder):
    rows = [("s", t, "u", ses, f"2024-01-0{d} 0{d}:00:00", q, p, None, 3, None) for d, (t, ses, q, p) in enumerate([("search", "x", "Red  Bolt", None), ("click", "x", "red bolt", 2), ("click", "", "red bolt", 1), ("odd", "x", "q", None), ("search", "y", "Blue", None)], 1)]
    df = spark.createDataFrame(rows, "site_id string, type string, shopper_id string, session_id string, occurred_at string, query string, position int, revenue double, result_count int, rescue_strategy string")
    df = df.withColumn("occurred_at", F.to_timestamp("occurred_at"))
    df.repartition(2).write.parquet(folder)
    return df


def test_events_stream_splits_and_the_rollup_equals_the_batch(spark, tmp_path):
    folder = str(tmp_path / "raw")
    raw = write_events(spark, folder)
    stream = lambda: spark.readStream.schema(raw.schema).parquet(folder)
    streams.stream_events(stream(), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "ok")).drop("batch")
    assert good.count() == 3 and {r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"no session", "unknown type"}
    good.write.parquet(str(tmp_path / "events"))
    streams.stream_query_rollup(stream(), str(tmp_path / "events"), str(tmp_path / "rollup"), str(tmp_path / "c2")).awaitTermination()
    now = spark.read.parquet(str(tmp_path / "rollup"))
    want = rollup_query_day(good)
    keys = ["day", "normalised_query", "searches", "clicks", "sessions"]
    assert sorted(map(tuple, now.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))


def test_impressions_and_sessions_count_by_event_time(spark, tmp_path):
    folder = str(tmp_path / "served")
    rows = spark.createDataFrame([("s", "A", "u", "click", f"2024-01-01 00:{m:02d}:00") for m in (0, 10, 50)], "site_id string, sku string, shopper_id string, type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(folder)
    source = spark.readStream.schema(rows.schema).parquet(folder)
    for name, stream, want in (("imp", streams.daily_impressions(source), [3]), ("ses", streams.stream_sessions(source), [1, 2])):
        column = "impressions" if name == "imp" else "events"
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r[column] for r in spark.table(name).collect()) == want


def test_price_deltas_make_the_next_snapshot(spark, tmp_path):
    docs = spark.createDataFrame([("s", "A", 10.0, 0.0, 5, 10.0, True, 0.0), ("s", "B", 20.0, 0.0, 0, 20.0, False, 0.0)], "site_id string, sku string, price double, sale_price double, inventory long, effective_price double, in_stock boolean, discount_pct double")
    docs.write.parquet(str(tmp_path / "docs"))
    updates = spark.createDataFrame([("s", "A", 12.0, 6.0, None, 1), ("s", "A", None, 9.0, 0, 2), ("s", "Z", 1.0, None, 1, 1)], "site_id string, sku string, price double, sale_price double, inventory long, at int")
    updates.write.parquet(str(tmp_path / "updates"))
    source = spark.readStream.schema(updates.schema).parquet(str(tmp_path / "updates"))
    streams.stream_price_deltas(source, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    a = spark.read.parquet(str(tmp_path / "out/snapshot=0")).where("sku = 'A'").first()
    assert (a.effective_price, a.in_stock, a.inventory) == (9.0, False, 0)
