from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsmill.operators import messages
from newsmill.streaming import jobs


def test_binary_files_exactly_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.eml").write_bytes("café".encode())
    (src / "b.txt").write_bytes(b"\xe9\xe8\xe7")
    read = lambda: jobs.stream_ingest(spark, jobs.object_stream(spark, str(src)), out)
    assert sorted(r.text for r in read().collect()) == ["café", "éèç"]
    (src / "c").write_bytes(b" ")
    assert sorted(r.reject_reason or "" for r in read().collect()) == ["", "", "blank"]
    assert read().count() == 3


def write_events(spark, folder, n, start, mode="append"):
    t0 = datetime(2024, 1, 1)
    rows = [(start + i, t0 + timedelta(minutes=start + i)) for i in range(n)]
    spark.createDataFrame(rows, "event_id int, ts timestamp").coalesce(1).write.mode(mode).parquet(folder)


def test_dedup_over_overlapping_reads(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: jobs.stream_dedup(spark, jobs.table_stream(spark, src, "*.parquet", 1), ["event_id"], "ts", out)
    write_events(spark, src, 100, 0)
    assert run().count() == 100
    write_events(spark, src, 100, 50)
    rows = run()
    assert rows.count() == rows.select("event_id").distinct().count() == 150


def test_rates_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        write_events(spark, src, 200, part * 200)
    stream = jobs.table_stream(spark, src, "*.parquet", 1)
    got = {(r.period_start, r.n) for r in jobs.stream_rate_windows(spark, stream, out=out).collect()}
    batch = spark.read.parquet(src).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    whole = {(r.p, r.n) for r in batch.select(F.col("w.start").alias("p"), "n").collect()}
    assert got == whole


def test_no_row_is_late(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(480)]
    spark.createDataFrame(rows, "event_id int, ts timestamp").repartition(48, "event_id").write.parquet(f"{src}/events.parquet")
    stream = lambda: jobs.table_stream(spark, src, "events.parquet", 7)
    rates = jobs.stream_rate_windows(spark, stream(), out=str(tmp_path / "a"))
    assert rates.count() == 480 and rates.agg(F.sum("n")).first()[0] == 480
    assert jobs.stream_dedup(spark, stream(), ["event_id"], out=str(tmp_path / "b")).count() == 480


def test_message_stream_once(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    df = spark.createDataFrame([("u1", "m1"), ("u2", "m2")], "url string, message string")
    run = lambda: jobs.stream_messages(jobs.table_stream(spark, src, "*.parquet"), out, state)
    df.write.parquet(src)
    run()
    df.write.mode("append").parquet(src)  # the same messages arrive again
    run()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2"]
    assert messages.message_sink(df, out, 99).count() == 2


def test_objects_in_batch(spark, tmp_path):
    from newsmill.sources.events import raw_object_decode, read_objects

    (tmp_path / "a.eml").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    assert sorted(r.text for r in raw_object_decode(read_objects(spark, str(tmp_path))).collect()) == ["one", "two"]
    assert read_objects(spark, str(tmp_path), "*.eml").count() == 1
