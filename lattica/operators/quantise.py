"""Bounding boxes and quantisation to an integer lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.vec import round_half_up


def bounding_box(points: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """min_*, max_*, centre_* of each column and max_size, for each group; partial and final aggregates."""
    folds = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))]
    box = points.groupBy(*(by or [])).agg(*folds)
    centres = [((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"centre_{c}") for c in cols]
    sizes = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in cols]
    return box.select("*", *centres, (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]).alias("max_size"))


def merge_boxes(boxes: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Union of boxes as bounding_box() gives them."""
    return boxes.groupBy(*(by or [])).agg(*[F.min(f"min_{c}").alias(f"min_{c}") for c in cols], *[F.max(f"max_{c}").alias(f"max_{c}") for c in cols])


def centred_square(box: DataFrame, cols: list[str], factor: float = 1.0) -> DataFrame:
    """The box grown to its largest extent around its centre, then scaled."""
    half = F.col("max_size") / 2 * factor
    return box.select(*[(F.col(f"centre_{c}") + s * half).alias(f"{n}_{c}") for c in cols for n, s in (("min", -1), ("max", 1))])


def quantise(points: DataFrame, cols: dict[str, str], width: int) -> DataFrame:
    """Adds lattice columns: floor((width - 1) * (f - min) / extent + 0.5) with one extent for all axes.

    ``cols``: real column -> lattice column. The box is one row, so it is broadcast. Points
    that all coincide go to the origin.
    """
    box = bounding_box(points, list(cols)).select(*[F.col(f"min_{c}").alias(f"_min_{c}") for c in cols], F.col("max_size").alias("_ext"))
    boxed = points.crossJoin(F.broadcast(box))  # a single row
    snap = lambda c: F.coalesce(round_half_up((width - 1) * ((F.col(c) - F.col(f"_min_{c}")) / F.nullif(F.col("_ext").cast("double"), F.lit(0.0)))), F.lit(0)).cast("long")
    return boxed.select(*points.columns, *[snap(c).alias(to) for c, to in cols.items()])


def object_to_lattice(c: Column, low: Column, extent: Column, width: int) -> Column:
    return (c - low) / extent * width


def lattice_to_object(c: Column, low: Column, extent: Column, width: int) -> Column:
    return c / width * extent + low
