"""Streams over event files: windowed counts with a watermark, deduplication, change of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    """A file stream with the schema of the table at the path; ts with the session's zone, as
    watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """start, event_type, n, total: tumbling windows; state is dropped after the watermark."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated(stream: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark (idempotent enqueue)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Processes what is there and stops; the result is read from the sink's files."""
    out = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    q = out.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def state_alerts(stream: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """key, at, state, before: a row whenever a key's state differs from the one seen last; a key's
    first row is silent. The last state is kept between triggers, so rows must reach the stream in
    order of time, within a trigger in any order. The batch twin is operators.changes.alerts."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(group_key, frames, last):
        rows = pd.concat(list(frames)).sort_values([at, tie])
        before = last.get[0] if last.exists else None
        out = []
        for t, s in zip(rows[at], rows[state]):
            if before is not None and s != before:
                out.append((group_key[0], t, s, before))
            before = s
        last.update((before,))
        yield pd.DataFrame(out, columns=[key, at, state, "before"])

    return stream.select(key, at, tie, state).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {at} {kinds[at]}, {state} {kinds[state]}, before {kinds[state]}", f"state {kinds[state]}", "append", GroupStateTimeout.NoTimeout
    )


def ingest(stream: DataFrame, path: str) -> None:
    """Each trigger's rows in a folder of its own, written over if the trigger is repeated; `latest`
    reads the newest row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/trigger={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def latest(spark: SparkSession, path: str, key: list[str], at: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    order = F.struct(at, "trigger")
    names = [c for c in rows.columns if c != "trigger"]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("r"))
    return best.select("r.*")
