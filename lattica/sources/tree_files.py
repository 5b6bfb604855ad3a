"""Trees as text: a line a leaf, its octants from the root down and what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def leaf_lines(leaves: DataFrame, dim: int, payload: str) -> DataFrame:
    """value: ``octants payload`` of each leaf (level, cx, cy[, cz]); the root alone has ``-`` for its octants, a null payload is ``-`` too."""
    axes = [f"c{a}" for a in "xyz"[:dim]]
    steps = F.when(F.col("level") > 0, F.sequence(F.col("level") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    digit = lambda s: sum((F.call_function("shiftright", F.col(c), s).bitwiseAND(F.lit(1)) * (1 << i) for i, c in enumerate(axes)), F.lit(0).cast("long"))
    path = F.array_join(F.transform(steps, digit).cast("array<string>"), "")
    shown = lambda c: F.when(c == "", "-").otherwise(c)
    return leaves.select(F.concat_ws(" ", shown(path), F.coalesce(F.col(payload).cast("string"), F.lit("-"))).alias("value"))


def write_leaves(leaves: DataFrame, path: str, dim: int, payload: str) -> None:
    """The lines of ``leaf_lines`` as text files, one a partition."""
    leaf_lines(leaves, dim, payload).write.mode("errorifexists").text(path)


def read_leaves(spark: SparkSession, path: str, dim: int, payload: str, kind: str = "int") -> DataFrame:
    """(level, cx, cy[, cz], payload): leaves read back line by line, so files of any size are split.

    Empty lines are passed over. A line whose octants aren't digits below 2**dim, or are
    more than 62, has null for its cell; a payload that is no ``kind`` is null.
    """
    axes = [f"c{a}" for a in "xyz"[:dim]]
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.when(F.get(parts, 0) == "-", F.lit("")).otherwise(F.get(parts, 0)).alias("_path"), F.get(parts, 1).try_cast(kind).alias(payload))
    good = F.col("_path").rlike(f"^[0-{(1 << dim) - 1}]{{0,62}}$")
    digits = F.transform(F.filter(F.split("_path", ""), lambda d: d != ""), lambda d: d.cast("long"))
    place = lambda i: F.aggregate(digits, F.lit(0).cast("long"), lambda c, d: c * 2 + F.shiftright(d, i).bitwiseAND(F.lit(1).cast("long")))
    return rows.select(F.when(good, F.length("_path")).alias("level"), *[F.when(good, place(i)).alias(c) for i, c in enumerate(axes)], payload)
