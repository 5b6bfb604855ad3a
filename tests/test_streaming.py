"""Streams give what the same rows give in a batch."""

from pyspark.sql import functions as F

from lattica.operators.quantise import bounding_box
from lattica.plans import views
from lattica.streaming.aggregates import running_boxes, windowed_stats


def test_streams_equal_batches(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for made, want, mode in (
        (running_boxes(stream, ["value"], ["event_type"]), bounding_box(rows, ["value"], ["event_type"]), "complete"),
        (windowed_stats(stream, "value", "ts", "7 days", "400 days", ["event_type"]), windowed_stats(rows, "value", "ts", "7 days", "400 days", ["event_type"]), "complete"),
    ):
        query = made.writeStream.format("memory").queryName("seen").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        counts = [c for c in want.columns if c not in ("mean", "variance", "deviation")]
        assert sorted(map(str, spark.table("seen").select(counts).collect())) == sorted(map(str, want.select(counts).collect()))
    assert views.polylines(spark, sf).count() == 1000
