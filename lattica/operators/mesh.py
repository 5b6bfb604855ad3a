"""Mesh topology: edges, adjacency, normals, welding, cutting and orientation.

Triangles are rows prim_id, a, b, c (vertex ids); vertices are rows vid, x, y, z.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import geom, vec
from lattica.operators.graph import connected_components
from lattica.operators.stats import prefix_sum


def edges(triangles: DataFrame) -> DataFrame:
    """(prim_id, side, u, v, lo, hi): the three directed edges, with the order-free key (lo, hi)."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(p).alias("u"), F.col(q).alias("v")) for i, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))])
    one = triangles.select("prim_id", F.explode(sides).alias("e")).select("prim_id", "e.side", "e.u", "e.v")
    return one.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v"))


def edge_index(triangles: DataFrame) -> DataFrame:
    """(lo, hi, n, prims): the triangles at each undirected edge."""
    return edges(triangles).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("prim_id")).alias("prims"))


def vertex_index(triangles: DataFrame) -> DataFrame:
    """(vid, n): triangles at each vertex."""
    return triangles.select("prim_id", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("vid")).groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


def dual_graph(triangles: DataFrame) -> DataFrame:
    """(u, v): pairs of triangles that share an edge, u < v."""
    one = edges(triangles).select("lo", "hi", "prim_id").distinct()
    p, q = one.withColumnRenamed("prim_id", "u"), one.withColumnRenamed("prim_id", "v")
    return p.join(q, ["lo", "hi"]).filter("u < v").select("u", "v").distinct()


def nonmanifold_edges(triangles: DataFrame) -> DataFrame:
    """(lo, hi, n): edges with more than two triangles."""
    return edges(triangles).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): sums of raw face normals, so weighted by area; coordinates ax.. bx.. tx.. are in the rows."""
    n = geom.triangle_normal(*(vec.point(p, 3) for p in "abt"))
    faces = triangles.select(F.explode(F.array("a", "b", "c")).alias("vid"), *[x.alias(f"n{a}") for x, a in zip(n, "xyz", strict=True)])
    return faces.groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])


def centroid(triangles: DataFrame, by: list[str]) -> DataFrame:
    """Area-weighted centroid and total area of each group."""
    corners = tuple(vec.point(p, 3) for p in "abt")
    area = vec.length(geom.triangle_normal(*corners)) / 2
    middle = vec.scale(vec.add(vec.add(corners[0], corners[1]), corners[2]), 1 / 3)
    rows = triangles.select(*by, area.alias("w"), *[(c * area).alias(f"m{a}") for c, a in zip(middle, "xyz", strict=True)])
    out = rows.groupBy(*by).agg(F.sum("w").alias("area"), *[F.sum(f"m{a}").alias(f"m{a}") for a in "xyz"])
    return out.filter("area > 0").select(*by, "area", *[(F.col(f"m{a}") / F.col("area")).alias(f"c{a}") for a in "xyz"])


def weld(vertices: DataFrame) -> DataFrame:
    """(vid, to): each vertex and the first of its exactly equal ones."""
    same = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("to"))
    return vertices.join(same, ["x", "y", "z"]).select("vid", "to")


def reindex(triangles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triangles with their vertex ids replaced by (vid, to)."""
    for c in "abc":
        triangles = triangles.join(mapping.select(F.col("vid").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return triangles


def translate(vertices: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    """Vertices moved by a vector; their box is a fold over the result."""
    return vertices.withColumns({a: F.col(a) + s for a, s in zip("xyz", by, strict=True)})


def invert(triangles: DataFrame) -> DataFrame:
    """All faces with the other winding: the first and last vertex change places."""
    return triangles.withColumns({"a": F.col("c"), "c": F.col("a")})


def compact(triangles: DataFrame, bucket: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(triangles with new ids, mapping vid -> to): the used vertices numbered from 0 in the order of their first use."""
    slots = F.explode(F.array(*[F.struct(F.col(c).alias("vid"), (F.col("prim_id").cast("long") * 3 + i).alias("at")) for i, c in enumerate("abc")]))
    used = triangles.select(slots.alias("s")).select("s.*").groupBy("vid").agg(F.min("at").alias("at"))
    ranked = prefix_sum(used.withColumn("one", F.lit(1).cast("long")), "one", F.floor(F.col("at") / bucket), ["at"], "to")
    mapping = ranked.select("vid", "to")
    return reindex(triangles, mapping), mapping


def triangle_slot(v: Column) -> Column:
    """Place (0 to 2) of a vertex in the row's triangle, -1 if it isn't there."""
    return F.when(v == F.col("a"), 0).when(v == F.col("b"), 1).when(v == F.col("c"), 2).otherwise(-1)


def triangle_vertex(slot: Column) -> Column:
    return F.get(F.array("a", "b", "c"), slot)


def triangle_step(v: Column, step: int) -> Column:
    """The vertex ``step`` places after v in the row's triangle (2: the one before); null if v isn't there."""
    slot = triangle_slot(v)
    return F.when(slot >= 0, triangle_vertex(F.pmod(slot + step, F.lit(3))))


def triangle_opposite(v: Column) -> tuple[Column, Column]:
    """The edge opposite a vertex, from the vertex before v to the one after it."""
    return triangle_step(v, 2), triangle_step(v, 1)


def triangle_has_edge(u: Column, v: Column) -> Column:
    return (triangle_slot(u) >= 0) & (triangle_slot(v) >= 0)


def triangle_key() -> Column:
    """The row's vertex ids in ascending order."""
    return F.array_sort(F.array("a", "b", "c"))


def same_winding(other: tuple[Column, Column, Column]) -> Column:
    """The row's triangle runs through the same vertices in the same cyclic order."""
    p, q, r = other
    own = F.array("a", "b", "c")
    return (own == F.array(p, q, r)) | (own == F.array(q, r, p)) | (own == F.array(r, p, q))


def opposite_triangles(triangles: DataFrame) -> DataFrame:
    """(prim_id, vid, other): across the edge opposite each corner, where exactly two triangles share it."""
    corner = F.when(F.col("side") == 0, F.col("c")).when(F.col("side") == 1, F.col("a")).otherwise(F.col("b"))
    one = edges(triangles).join(triangles.select("prim_id", "a", "b", "c"), "prim_id").select("prim_id", "lo", "hi", corner.alias("vid"))
    pairs = one.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("prim_id").alias("p"), F.max("prim_id").alias("q")).filter("n = 2 and p <> q")
    return one.join(pairs, ["lo", "hi"]).select("prim_id", "vid", F.when(F.col("prim_id") == F.col("p"), F.col("q")).otherwise(F.col("p")).alias("other"))


def local_flips(triangles: DataFrame) -> DataFrame:
    """(prim_id, n, flip): how many neighbours run a shared edge the same way; more than one calls for a flip.

    All triangles are judged as they are given, so the order of rows doesn't matter.
    """
    one = edges(triangles)
    other = one.select("lo", "hi", F.col("prim_id").alias("other"), F.col("u").alias("v_u"))
    same = one.join(other, ["lo", "hi"]).filter("prim_id <> other and u = v_u").groupBy("prim_id").agg(F.count(F.lit(1)).alias("n"))
    return triangles.select("prim_id").join(same, "prim_id", "left").select("prim_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 1).alias("flip"))


def split_sheets(triangles: DataFrame, bucket: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(triangles with new ids and their sheet, copies vid -> to of a sheet) with edges of more than two triangles taken apart.

    A sheet is what hangs together by edges of exactly two triangles; its windings are made
    equal where they can be. Each vertex of an edge with more triangles gets a copy for
    every sheet but the one with the smallest triangle, numbered after all vertices.
    """
    every = edges(triangles)
    shared = every.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    turned = orient(triangles)
    made = triangles.join(turned, "prim_id").select("prim_id", F.when(F.col("flip"), F.col("c")).otherwise(F.col("a")).alias("a"), "b", F.when(F.col("flip"), F.col("a")).otherwise(F.col("c")).alias("c"), F.col("component").alias("sheet"))
    broken = shared.filter("n > 2").select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()
    held = made.select("sheet", F.explode(F.array("a", "b", "c")).alias("vid")).distinct().join(broken, "vid", "left_semi")
    first = held.groupBy("vid").agg(F.min("sheet").alias("first"))
    more = held.join(first, "vid").filter("sheet <> first").select("vid", "sheet")
    most = triangles.agg((F.max(F.greatest("a", "b", "c")) + 1).alias("most"))
    copies = prefix_sum(more.withColumn("one", F.lit(1).cast("long")), "one", F.floor(F.col("vid") / bucket), ["vid", "sheet"], "rank")
    copies = copies.crossJoin(F.broadcast(most)).select("vid", "sheet", (F.col("most") + F.col("rank")).alias("to"))  # one row
    for c in "abc":
        made = made.join(copies.select(F.col("vid").alias(c), "sheet", "to"), [c, "sheet"], "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return made.select("prim_id", "sheet", "a", "b", "c"), copies


def iso_triangles(triangles: DataFrame, cut: float) -> DataFrame:
    """(prim_id, piece, p, q, r): the triangles that remain below the cut.

    A vertex is (lo, hi): lo = hi for one that is kept, else the cut point of that edge
    (see ``cut_points``). With two vertices kept there are two pieces, with one a corner.
    """
    good = [F.col(f"d{c}") < cut for c in "abc"]
    kept = sum((g.cast("int") for g in good), F.lit(0))
    own = lambda i: F.struct(F.col("abc"[i]).alias("lo"), F.col("abc"[i]).alias("hi"))
    on = lambda i, j: F.struct(F.least("abc"[i], "abc"[j]).alias("lo"), F.greatest("abc"[i], "abc"[j]).alias("hi"))
    made = lambda *corners: F.struct(*[c.alias(n) for c, n in zip(corners, "pqr", strict=True)])
    pieces = F.when(kept == 3, F.array(made(own(0), own(1), own(2))))
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3  # i is the odd one out
        pieces = pieces.when((kept == 2) & ~good[i], F.array(made(own(j), own(k), on(k, i)), made(own(j), on(k, i), on(j, i))))
        pieces = pieces.when((kept == 1) & good[i], F.array(made(own(i), on(i, j), on(i, k))))
    return triangles.select("prim_id", F.posexplode(pieces).alias("piece", "t")).select("prim_id", "piece", "t.*")


def iso_reduce(triangles: DataFrame, cut: float) -> DataFrame:
    """(prim_id, kept, pieces): vertices with value below the cut, and the triangles that remain after cutting."""
    kept = sum((F.when(F.col(f"d{c}") < cut, 1).otherwise(0) for c in "abc"), F.lit(0))
    pieces = F.when(F.col("kept") == 3, 1).when(F.col("kept") == 2, 2).when(F.col("kept") == 1, 1).otherwise(0)
    return triangles.withColumn("kept", kept).withColumn("pieces", pieces).select("prim_id", "kept", "pieces")


def cut_points(triangles: DataFrame, cut: float) -> DataFrame:
    """(lo, hi, t): the one cut point of each edge across the iso-value, t from lo to hi."""
    pairs = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v"), F.col(f"d{p}").alias("du"), F.col(f"d{q}").alias("dv")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    sides = triangles.select(F.explode(pairs).alias("e")).select("e.*").filter((F.col("du") < cut) != (F.col("dv") < cut))
    up = F.col("u") < F.col("v")
    low, high = F.when(up, F.col("du")).otherwise(F.col("dv")), F.when(up, F.col("dv")).otherwise(F.col("du"))
    return sides.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), ((cut - low) / (high - low)).alias("t")).distinct()


def orient(triangles: DataFrame) -> DataFrame:
    """(prim_id, component, flip): windings made equal across edges of two triangles.

    Neighbours that run their edge in the same direction must differ in ``flip``. Each
    triangle stands twice, kept and flipped, and is joined with the matching copies of its
    neighbours; the components of that double cover tell both the component (its smallest
    triangle, which keeps its winding) and the flip. A component that cannot be oriented
    is one in the cover too, and nothing of it is flipped.
    """
    one = edges(triangles)
    pairs = one.groupBy("lo", "hi").count().filter("count = 2").select("lo", "hi")
    p = one.join(pairs, ["lo", "hi"], "left_semi")
    q = p.select("lo", "hi", F.col("prim_id").alias("other"), F.col("u").alias("qu"))
    links = p.join(q, ["lo", "hi"]).filter("prim_id < other").select("prim_id", "other", F.when(F.col("u") == F.col("qu"), 1).otherwise(0).alias("odd"))
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    cover = links.withColumn("s", side).select((F.col("prim_id") * 2 + F.col("s")).alias("u"), (F.col("other") * 2 + F.col("s").bitwiseXOR(F.col("odd"))).alias("v"))
    parts = connected_components(cover).filter("node % 2 = 0").select(F.shiftright("node", 1).alias("prim_id"), F.shiftright("component", 1).alias("component"), (F.col("component") % 2 == 1).alias("flip"))
    return triangles.select("prim_id").join(parts, "prim_id", "left").select("prim_id", F.coalesce("component", "prim_id").alias("component"), F.coalesce("flip", F.lit(False)).alias("flip"))


def region_merge(normals: DataFrame, by: str, limit: float = math.pi / 2) -> DataFrame:
    """(by, region, n, nx, ny, nz): neighbouring unit normals of a ring merged while their angle is within the limit.

    A ring is small and its merges are sequential, so each is handled by one call. The
    closest pair merges first, ties by position; a region's normal is the sum of its parts.
    """

    def merge(ring: pd.DataFrame) -> pd.DataFrame:
        parts = [[1, r.nx, r.ny, r.nz] for r in ring.sort_values("ord").itertuples()]

        def angle(p, q) -> float:
            size = math.sqrt(sum(x * x for x in p[1:]) * sum(x * x for x in q[1:]))
            return math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(p[1:], q[1:], strict=True)) / size))) if size else math.pi

        while len(parts) > 1:
            turns = range(len(parts) if len(parts) > 2 else 1)
            best, at = min((angle(parts[i], parts[(i + 1) % len(parts)]), i) for i in turns)
            if best > limit:
                break
            other = (at + 1) % len(parts)
            parts[at] = [x + y for x, y in zip(parts[at], parts[other], strict=True)]
            del parts[other]
        return pd.DataFrame([(ring[by].iloc[0], i, *p) for i, p in enumerate(parts)], columns=[by, "region", "n", "nx", "ny", "nz"])

    kind = normals.schema[by].dataType.simpleString()
    return normals.select(by, "ord", "nx", "ny", "nz").groupBy(by).applyInPandas(merge, f"{by} {kind}, region int, n int, nx double, ny double, nz double")
