"""Mesh, material, polyline and option files as DataFrames, and back.

Lines keep their order by a number made in the reader: files are read whole, one row per
file, so a line's number is its position in its own file.
"""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, tokens): non-empty lines without comments, split at white space."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))
    cleaned = whole.withColumn("line", F.trim(F.regexp_replace("line", r"#.*$|\t", " "))).filter("line <> ''")
    return cleaned.select("path", "line_no", F.split("line", r"\s+").alias("tokens"))


def read_obj(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices path, vid, x, y, z; faces path, prim_id, a, b, c), ids from 0 in each file. A face that isn't a triangle raises."""
    rows = lines(spark, paths).withColumn("tag", F.get("tokens", 0))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    vertices = rows.filter("tag = 'v'").select("path", rank.alias("vid"), *[F.get("tokens", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])
    index = lambda i: (F.get(F.split(F.get("tokens", i), "/"), 0).cast("int") - 1)
    three = F.when(F.size("tokens") == 4, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a triangle: "), F.array_join("tokens", " "))).cast("boolean"))
    faces = rows.filter("tag = 'f'").filter(three).select("path", rank.alias("prim_id"), *[index(i + 1).alias(c) for i, c in enumerate("abc")])
    return vertices, faces


def read_mtl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, ka, kd, ks, ns, map_ka, map_kd): a row for each material."""
    rows = lines(spark, paths).withColumn("tag", F.lower(F.get("tokens", 0)))
    run = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("name", F.last(F.when(F.col("tag") == "newmtl", F.get("tokens", 1)), ignorenulls=True).over(run)).filter("name is not null")
    rgb = lambda t: F.max(F.when(F.col("tag") == t, F.transform(F.slice("tokens", 2, 3), lambda c: c.cast("double")))).alias(t)
    text = lambda t: F.max(F.when(F.col("tag") == t, F.get("tokens", 1))).alias(t)
    return named.groupBy("path", "name").agg(rgb("ka"), rgb("kd"), rgb("ks"), F.max(F.when(F.col("tag") == "ns", F.get("tokens", 1).cast("double"))).alias("ns"), text("map_ka"), text("map_kd"))


def read_polylines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(label, ord, fx, fy): one file per polyline; labels follow the order of ``paths``, by their full names."""
    resolve = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    full = []
    for i, p in enumerate(paths):
        path = resolve(p)
        system = path.getFileSystem(conf)
        full.append((_plain(path.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().toString()), i))
    labels = spark.createDataFrame(full, "name string, label int")  # a row per file given
    rows = lines(spark, paths).filter(F.size("tokens") >= 2).withColumn("name", F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/"))
    return rows.join(F.broadcast(labels), "name").select("label", F.col("line_no").alias("ord"), F.get("tokens", 0).cast("double").alias("fx"), F.get("tokens", 1).cast("double").alias("fy"))


def _plain(uri: str) -> str:
    """A URI without escapes, and with one slash after ``file:``."""
    return re.sub("^file:/+", "file:/", urllib.parse.unquote(uri))


def read_path_list(spark: SparkSession, path: str) -> list[str]:
    """File names of a list, up to its first blank line."""
    out: list[str] = []
    for line in spark.read.text(path, wholetext=True).first()["value"].splitlines():
        if not line.strip():
            break
        out += [t for t in line.split() if not t.startswith("#")]
    return out


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY value lines; # starts a comment, the last value of a key wins."""
    out: dict[str, str] = {}
    for line in spark.read.text(path, wholetext=True).first()["value"].splitlines():
        key, _, value = line.split("#")[0].strip().partition(" ")
        if key:
            out[key] = value.strip()
    return out


def option_bool(options: dict[str, str], key: str, default: bool = False) -> bool:
    """Everything but 0, false, False and FALSE is true."""
    return options[key] not in ("0", "false", "False", "FALSE") if key in options else default


def option_int(options: dict[str, str], key: str, default: int = 0) -> int:
    """Leading digits of the value, 0 without any."""
    if key not in options:
        return default
    digits = ""
    for c in options[key]:
        if not (c.isdigit() or (c in "+-" and not digits)):
            break
        digits += c
    return int(digits) if digits.strip("+-") else 0


def _numbered(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces without repeated vertices."""
    return faces.filter("a <> b and b <> c and a <> c")


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One text file: vertices by vid, then faces from 1; degenerate faces are dropped."""
    v = vertices.select(F.lit(0).alias("kind"), F.col("vid").cast("long").alias("at"), F.format_string("v %.12g %.12g %.12g", "x", "y", "z").alias("line"))
    f = _numbered(vertices, faces).select(F.lit(1).alias("kind"), F.col("prim_id").cast("long").alias("at"), F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("line"))
    _write_lines(v.unionAll(f), path)


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """ASCII PLY; the header counts the faces that are written."""
    good = _numbered(vertices, faces)
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", "property float x", "property float y", "property float z", f"element face {good.count()}", "property list uchar int vertex_indices", "end_header"]
    h = vertices.sparkSession.createDataFrame([(0, i, s) for i, s in enumerate(head)], "kind int, at long, line string")
    v = vertices.select(F.lit(1).alias("kind"), F.col("vid").cast("long").alias("at"), F.format_string("%.12g %.12g %.12g", "x", "y", "z").alias("line"))
    f = good.select(F.lit(2).alias("kind"), F.col("prim_id").cast("long").alias("at"), F.format_string("3 %d %d %d", "a", "b", "c").alias("line"))
    _write_lines(h.unionAll(v).unionAll(f), path)


def _write_lines(rows: DataFrame, path: str) -> None:
    # a mesh file is one ordered stream by its format
    rows.coalesce(1).sortWithinPartitions("kind", "at").select("line").write.mode("overwrite").text(path)


def write_polylines(points: DataFrame, path: str) -> None:
    """A folder per label with the points in order."""
    rows = points.select("label", "ord", F.format_string("%.12g %.12g", "fx", "fy").alias("line"))
    rows.repartition("label").sortWithinPartitions("label", "ord").select("label", "line").write.mode("overwrite").partitionBy("label").text(path)


def write_label_meshes(triangles: DataFrame, path: str) -> None:
    """A folder ``label=<label>`` with the OBJ lines of each label's triangles (ax.. bx.. tx..); equal points are one vertex.

    A mesh file is one ordered stream by its format, so a label is a task.
    """
    corners = triangles.select("label", F.explode(F.array(*[F.struct(*[F.col(p + a).alias(a) for a in "xyz"]) for p in "abt"])).alias("v")).select("label", "v.*").distinct()
    numbered = corners.withColumn("vid", F.row_number().over(Window.partitionBy("label").orderBy("x", "y", "z")))
    faces = triangles
    for p in "abt":
        faces = faces.join(numbered.select("label", F.col("vid").alias(f"v{p}"), *[F.col(a).alias(p + a) for a in "xyz"]), ["label", *[p + a for a in "xyz"]])
    v = numbered.select("label", F.lit(0).alias("kind"), "vid", F.format_string("v %.12g %.12g %.12g", *[F.col(a).cast("double") for a in "xyz"]).alias("line"))
    f = faces.filter("va <> vb and vb <> vt and va <> vt").select("label", F.lit(1).alias("kind"), F.col("va").alias("vid"), F.format_string("f %d %d %d", "va", "vb", "vt").alias("line"))
    v.unionAll(f).repartition("label").sortWithinPartitions("label", "kind", "vid", "line").select("label", "line").write.mode("overwrite").partitionBy("label").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """ax ay bx by lines, each undirected edge in both directions."""
    both = edges.select("ax", "ay", "bx", "by").unionAll(edges.select("bx", "by", "ax", "ay"))
    both.select(F.format_string("%.12g %.12g %.12g %.12g", *both.columns)).write.mode("overwrite").text(path)
