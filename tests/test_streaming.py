import time

from pyspark.sql import functions as F

from lexmill.streaming import watch

SF = "/root/testdata/sf0.001"


def parts(spark, tmp_path):
    """The events table as several files in order of time."""
    path = str(tmp_path / "events")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("week", F.floor(F.dayofmonth("ts") / 8))
    for week in range(4):  # one after another: a file stream reads in order of the files' times
        e.where(F.col("week") == week).drop("week").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def test_windows_equal_the_batch(spark, tmp_path):
    path = parts(spark, tmp_path)
    got = watch.run_to_table(watch.windowed(watch.events(spark, path)), str(tmp_path / "w"), "append")
    want = watch.windowed(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    last = want.agg(F.max("start")).first()[0]  # the last window is still open under append
    as_set = lambda d: {(r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in d.where(F.col("start") < last).collect()}
    assert as_set(got) == as_set(want) and as_set(want)


def test_deduplication_keeps_one_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "twice")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.union(e).write.parquet(path)
    got = watch.run_to_table(watch.deduplicated(watch.events(spark, path), ["event_id"], "60 days"), str(tmp_path / "d"))
    assert got.count() == got.select("event_id").distinct().count() == e.count()


def test_state_alerts_equal_the_batch_twin(spark, tmp_path):
    from lexmill.operators import changes

    path = parts(spark, tmp_path)
    stream = watch.events(spark, path, files_a_trigger=1)
    got = watch.run_to_table(watch.state_alerts(stream, "user_id", "ts", "event_id", "event_type"), str(tmp_path / "a"))
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    want = changes.alerts(batch.withColumn("when", F.struct("ts", "event_id")), ["user_id"], "when", "event_type")
    as_list = lambda d: sorted((r["user_id"], r["ts"], r["event_type"], r["before"]) for r in d.collect())
    assert as_list(got) == as_list(want) and got.count() > 0


def test_ingest_keeps_the_newest_row_and_repeats_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v string, ts timestamp"
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 2)]]):
        df = spark.createDataFrame([(k, v, t) for k, v, t in rows], "k int, v string, t int").selectExpr("k", "v", "timestamp_seconds(t) AS ts")
        df.coalesce(1).write.mode("append").parquet(src)
        watch.ingest(spark.readStream.schema(schema).parquet(src), out)
        watch.ingest(spark.readStream.schema(schema).parquet(src), out)
    assert sorted((r["k"], r["v"]) for r in watch.latest(spark, out, ["k"], "ts").collect()) == [(1, "c"), (2, "b"), (3, "d")]
