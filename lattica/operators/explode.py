"""Exploded views: offsets of labels away from an anchor, spread through the graph of touching labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vec
from lattica.operators.graph import k_rings
from lattica.session import scratched, write_and_reread


@scratched
def explode_offsets(pairs: DataFrame, anchor, factor: float, max_ring: int = 16) -> DataFrame:
    """(label, ring, ox, oy, oz): how far each label moves away from the anchor, which stays.

    pairs: a, b, nx, ny, nz, area of labels that touch (``gvd.pair_attributes``), the
    direction pointing from a to b; both orders of a pair may be given. A neighbour of the
    anchor moves along their common direction; a label of a further ring moves along the
    sum of its inner neighbours' offsets, weighted by the area they share. Every offset is
    ``factor`` times the ring long, or zero where the directions cancel out. Labels that
    are not reached within ``max_ring`` rings have no row, and a null label, direction or
    area takes no part.
    """
    n = [f"n{a}" for a in "xyz"]
    one = pairs.select("a", "b", *n, "area").dropna()
    both = one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"), *[(-F.col(c)).alias(c) for c in n], "area"))
    links = write_and_reread(both.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in n], F.sum("area").alias("area")), "explode-links")
    start = pairs.sparkSession.range(1).select(F.lit(anchor).cast(dict(links.dtypes)["a"]).alias("node"))
    rings = write_and_reread(k_rings(links.select(F.col("a").alias("u"), F.col("b").alias("v")), start, max_ring).select(F.col("node").alias("label"), "ring"), "explode-rings")
    last = rings.filter("ring = 0").select("label", "ring", *[F.lit(0.0).alias(f"o{a}") for a in "xyz"])
    out = last
    for ring in range(1, max_ring + 1):
        here = links.join(last.withColumnRenamed("label", "a"), "a").join(rings.filter(F.col("ring") == ring).select(F.col("label").alias("b")), "b")
        push = n if ring == 1 else [f"o{a}" for a in "xyz"]
        weight = F.lit(1.0) if ring == 1 else F.col("area")
        summed = here.groupBy("b").agg(*[F.sum(F.col(c) * weight).alias(f"s{a}") for c, a in zip(push, "xyz", strict=True)])
        s = vec.point("s", 3)
        scale = F.coalesce(F.lit(factor * ring) / F.nullif(vec.length(s), F.lit(0.0)), F.lit(0.0))
        last = write_and_reread(summed.select(F.col("b").alias("label"), F.lit(ring).alias("ring"), *[(c * scale).alias(f"o{a}") for c, a in zip(s, "xyz", strict=True)]), "explode-ring")
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out


def explode_step(distances: DataFrame, distance: str, most: int) -> Column:
    """How far labels can move at once: seven tenths of the smallest distance, rounded down, ``most`` at most; ``most`` of an empty table."""
    least = distances.agg(F.min(distance)).first()[0]
    return F.lit(most if least is None else min(most, least * 7 // 10))


def moved(vertices: DataFrame, offsets: DataFrame, step: Column) -> DataFrame:
    """Vertices (label, x, y, z, ..) after each label has moved ``step`` along its offset's direction; labels without one stay."""
    o = vec.point("o", 3)
    size = F.nullif(vec.length(o), F.lit(0.0))
    way = offsets.select("label", *[F.coalesce(c / size * step, F.lit(0.0)).alias(f"_m{a}") for c, a in zip(o, "xyz", strict=True)])
    joined = vertices.join(way, "label", "left")
    return joined.select(*[(F.col(c) + F.coalesce(f"_m{c}", F.lit(0.0))).alias(c) if c in ("x", "y", "z") else F.col(c) for c in vertices.columns])
