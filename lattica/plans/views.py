"""Geometry derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.octree import OctreeOptions
from lattica.operators.quantise import quantise

WIDTH = 4096
TREE = OctreeOptions(max_level=6, width=WIDTH, dim=2)
#: Line items of which one task folds the pairs.
LINES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx, fy, label: distinct points from lineitem; the factor makes both axes comparable."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_quantity") * 2000).alias("fx"), F.col("l_extendedprice").alias("fy"), (F.col("l_suppkey") % 4).cast("int").alias("label")).distinct()


def lattice_points(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    return quantise(points2(spark, sf_dir), {"fx": "x", "fy": "y"}, width)


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, ord, fx, fy: the events of a user in time order; whole seconds since 2024 and the scaled value."""
    ts = F.col("ts")
    seconds = F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("label"), turn.alias("ord"), seconds.cast("long").alias("fx"), (F.col("value") * 8000).alias("fy"))


def segments(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """label, ord, ax, ay, bx, by: consecutive points of each polyline on the lattice."""
    placed = quantise(polylines(spark, sf_dir), {"fx": "x", "fy": "y"}, width)
    line = Window.partitionBy("label").orderBy("ord")
    made = placed.select("label", "ord", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(line).alias("bx"), F.lead("y").over(line).alias("by"))
    return made.filter("bx is not null")


def points3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, label, x, y, z: the first three components of each embedding on a lattice."""
    at = lambda i: F.floor((F.get("embedding", i).cast("double") + 1) * 512 + 0.5).cast("long")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prim_id, label, a, b, c and ax.. bx.. tx..: three consecutive points make a triangle."""
    p = points3(spark, sf_dir)
    out = p.select(F.col("vid").alias("prim_id"), "label", F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (F.col("vid") + 2).alias("c"), *[F.col(a).alias(f"a{a}") for a in "xyz"])
    for name, to in (("b", "b"), ("c", "t")):
        out = out.join(p.select(F.col("vid").alias(name), *[F.col(a).alias(f"{to}{a}") for a in "xyz"]), name)
    return out


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w: suppliers (even numbers) and parts (odd) that share a line item, with the least quantity as weight."""
    rows = table(spark, sf_dir, "lineitem")
    ends = rows.select((F.col("l_suppkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v"), "l_quantity")
    # nearly all pairs differ, so folding them before they move would hold a whole split of them
    return ends.repartition(1 + rows.count() // LINES, "u", "v").groupBy("u", "v").agg(F.min("l_quantity").cast("long").alias("w"))
