"""Streams over a file source give what the batch form gives."""

from pyspark.sql import functions as F

from quern.operators import safety as S
from quern.streaming import events as E

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    return E.timed(E.read_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1), "ts", "60 days")


def test_tumbling(spark, data, tmp_path):
    got = E.run_to_end(E.tumbling(stream(spark, data, tmp_path), "ts", "value", "1 hour"), "tumbling_out", "complete")
    want = E.tumbling(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 hour")
    key = lambda d: sorted((str(r["start"]), r["n"], round(r["total"], 6)) for r in d.collect())
    assert key(got) == key(want)


def test_sessions_and_rates(spark, data, tmp_path):
    src = stream(spark, data, tmp_path)
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert E.run_to_end(E.sessions(src, "ts", "user_id", "6 hours"), "sessions_out", "complete").count() == E.sessions(batch, "ts", "user_id", "6 hours").count()
    rates = E.run_to_end(E.sliding_counts(src, "ts", "user_id", "2 hours", "1 hour", 1), "rates_out", "complete")
    assert rates.filter("NOT exceeded").count() == 0 and rates.count() > 0


def test_duplicates_and_dead_letters(spark, data, tmp_path):
    src = stream(spark, data, tmp_path)
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert E.run_to_end(E.deduplicated(src, ["event_id"]), "dedup_out").count() == n
    sink = E.split_valid({"click": F.col("event_type") == "click"}, E.parquet_once(str(tmp_path / "ok")), E.parquet_once(str(tmp_path / "dead")))
    q = src.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    ok, dead = (spark.read.parquet(str(tmp_path / x)) for x in ("ok", "dead"))
    assert ok.count() + dead.count() == n and ok.filter("event_type <> 'click'").count() == 0


def test_parts(spark, tmp_path):
    spark.createDataFrame([("Account 1234",), ("a secret",)], "text string").write.json(str(tmp_path / "parts"))
    out = E.guarded_parts(E.read_stream(spark, str(tmp_path / "parts"), "text string", "json"), "text", "secret", S.redact_numbers)
    assert [r["text"] for r in E.run_to_end(out, "parts_out").collect()] == ["Account [#]"]


def test_ring_tail(spark, tmp_path):
    """The last lines of each key over several files, as the batch form has them."""
    for i in range(3):
        spark.createDataFrame([(k, f"{k}{i}{j}") for k in "ab" for j in range(2 + i)], "k string, line string").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    src = E.read_stream(spark, str(tmp_path / "log"), "k string, line string", "json", files_per_trigger=1)
    told = E.run_to_end(E.ring_tail(src, "k", "line", 4), "ring_out", "update").collect()
    last = {r["k"]: r["lines"] for r in sorted(told, key=lambda r: len(r["lines"]))}
    assert set(last) == {"a", "b"} and all(len(x) <= 4 for r in told for x in [r["lines"]])
    assert max(len(r["lines"]) for r in told if r["k"] == "a") == 4


def test_kafka_rows(spark):
    """What follows the source, on messages as the connector gives them; the connector itself is not on this machine."""
    rows = [(b"k", b'{"id": 1, "name": "x"}', "t", 0, 5), (None, b"not json", "t", 1, 6), (b"k", None, "t", 1, 7)]
    m = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long").withColumn("timestamp", F.current_timestamp())
    got = {r["offset"]: r for r in E.kafka_rows(m, "id long, name string").collect()}
    assert got[5]["id"] == 1 and got[5]["message_key"] == "k" and got[5]["raw"] is None
    assert got[6]["id"] is None and got[6]["raw"] == "not json" and got[7]["raw"] is None
    options = E.kafka_options("h:9092", "t", per_trigger=10)
    assert options["subscribe"] == "t" and options["maxOffsetsPerTrigger"] == "10"
