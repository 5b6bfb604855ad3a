"""Running boxes and statistics over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.quantise import bounding_box
from lattica.operators.stats import population_stats


def running_boxes(points: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Bounding boxes by group; start it with output mode 'update' or 'complete'. State is a row per group."""
    return bounding_box(points, cols, by)


def windowed_stats(rows: DataFrame, value: str, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Population statistics per time window and group; rows later than ``late`` are dropped with their window's state."""
    timed = rows.withWatermark(time, late).withColumn("window", F.window(time, window))
    return population_stats(timed, value, ["window", *by])
