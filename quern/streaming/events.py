"""Structured Streaming forms of the event operators.

Parquet timestamps here carry no zone; they are cast first, since a watermark
needs a timestamp with one. State is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def timed(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def guarded_parts(df: DataFrame, text: str, blocked: str | None = None, change: Callable[[Column], Column] | None = None) -> DataFrame:
    """Part by part: drop parts with a blocked word, change the others. No state."""
    out = df if blocked is None else df.filter(~F.col(text).contains(blocked))
    return out if change is None else out.withColumn(text, change(F.col(text)))


def tumbling(df: DataFrame, ts: str, value: str, width: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Average, minimum, maximum, total and count of each window."""
    g = df.groupBy(F.window(ts, width).alias("w"), *keys)
    return g.agg(F.avg(value).alias("average"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.sum(value).alias("total"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "average", "minimum", "maximum", "total", "n")


def sliding_counts(df: DataFrame, ts: str, key: str, width: str = "60 seconds", slide: str = "10 seconds", limit: int = 30) -> DataFrame:
    """Events of each key in each sliding window, and whether the limit is reached."""
    g = df.groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), key, "n", (F.col("n") >= limit).alias("exceeded"))


def sessions(df: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    g = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def split_valid(rules: dict[str, Column], valid: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: valid rows to one place, the others with their broken rules to a dead-letter place."""
    from quern.operators.quality import quarantined

    def sink(batch: DataFrame, epoch: int) -> None:
        marked = quarantined(batch, rules).persist()
        valid(marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), epoch)
        dead(marked.filter(F.size("broken_rules") > 0), epoch)
        marked.unpersist()

    return sink


def parquet_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each epoch to its own folder, so that a repeated epoch replaces itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through a memory table; for tests and small results."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def kafka_options(servers: str, topics: str, starting: str = "latest", per_trigger: int | None = None, **more: str) -> dict[str, str]:
    """Options of the Kafka source (its connector comes with Spark's packages, not with Spark); Event Hubs speak the same protocol."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": starting, "failOnDataLoss": "true", **more}
    return out if per_trigger is None else out | {"maxOffsetsPerTrigger": str(per_trigger)}


def read_kafka(spark: SparkSession, servers: str, topics: str, schema: str, **options) -> DataFrame:
    return kafka_rows(spark.readStream.format("kafka").options(**kafka_options(servers, topics, **options)).load(), schema)


def kafka_rows(messages: DataFrame, schema: str) -> DataFrame:
    """Messages as rows: the JSON value's fields, then key, topic, partition, offset and time. A value that does not parse has null fields and stays in ``raw``."""
    text = F.col("value").cast("string")
    parsed = messages.select(F.from_json(text, schema).alias("v"), F.col("key").cast("string").alias("message_key"), "topic", "partition", "offset", F.col("timestamp").alias("message_time"), text.alias("raw"))
    bad = F.forall(F.array(*[F.col(f"v.{f}").isNull() for f in parsed.schema["v"].dataType.names]), lambda x: x)
    return parsed.withColumn("raw", F.when(bad, F.col("raw"))).select("v.*", "message_key", "topic", "partition", "offset", "message_time", "raw")


def ring_tail(df: DataFrame, key: str, line: str, n: int = 500) -> DataFrame:
    """The last ``n`` lines of each key, told anew when a key has new ones: ``key, lines``. State is ``n`` lines a key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for part in parts:
            held = (held + part[line].tolist())[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [name[0]], "lines": [held]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, line).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, lines array<string>", "lines array<string>", "update", GroupStateTimeout.NoTimeout)
