"""Spatial joins: range joins by grid buckets, nearest features, walks and picks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import geom, solids, vec
from lattica.session import write_and_reread


def segment_cells(segments: DataFrame, side: int, count: int) -> DataFrame:
    """Adds cx, cy: each closed cell of a uniform grid that a segment (ax, ay, bx, by) meets.

    Candidates are generated from the segment's own box, so nothing is joined.
    """
    low = lambda c: F.greatest(F.ceil(c / side) - 1, F.lit(0))
    high = lambda c: F.least(F.floor(c / side), F.lit(count - 1))
    spread = segments
    for axis in "xy":
        a, b = F.col(f"a{axis}"), F.col(f"b{axis}")
        spread = spread.withColumn(f"c{axis}", F.explode(F.sequence(low(F.least(a, b)), high(F.greatest(a, b)))))
    corner = (F.col("cx") * side, F.col("cy") * side)
    return spread.filter(geom.segment_box_overlap(vec.point("a", 2), vec.point("b", 2), corner, tuple(c + side for c in corner)))


def triangle_cells(triangles: DataFrame, side: int, count: int) -> DataFrame:
    """Adds cx, cy, cz: each closed cell that a triangle (ax.., bx.., tx..) meets."""
    return solids.cells_of(triangles, side, count)


def cell_walk(segments: DataFrame, side: int, count: int, key: list[str]) -> DataFrame:
    """The cells of each segment in the order from its first to its second end, with step from 0."""
    toward = lambda axis: F.when(F.col(f"b{axis}") >= F.col(f"a{axis}"), F.col(f"c{axis}")).otherwise(-F.col(f"c{axis}"))
    order = Window.partitionBy(*key).orderBy(toward("x") + toward("y"), toward("x"))
    return segment_cells(segments, side, count).withColumn("step", F.row_number().over(order) - 1)


def multi_label_cells(cells: DataFrame) -> DataFrame:
    """Cells with several labels: cx, cy, n_labels, low and high label."""
    found = cells.groupBy("cx", "cy").agg(F.count_distinct("label").alias("n_labels"), F.min("label").alias("low"), F.max("label").alias("high"))
    return found.filter("low <> high")


def first_labels(cells: DataFrame, order: list[str], most: int = 2) -> DataFrame:
    """The first ``most`` labels of each cell by arrival, each with its longest segment's squared length."""
    length2 = vec.length2(vec.sub(vec.point("b", 2), vec.point("a", 2)))
    each = cells.groupBy("cx", "cy", "label").agg(F.min(F.struct(*order)).alias("first"), F.max(length2).alias("length2"))
    turn = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("first", "label"))
    return each.withColumn("turn", turn).filter(F.col("turn") <= most).select("cx", "cy", "turn", "label", "length2")


def label_conflicts(cells: DataFrame) -> DataFrame:
    """Pairs of touching cells of which one holds several labels or the two hold different ones.

    Each cell looks up half of its eight neighbours, so a pair appears once.
    """
    labels = cells.groupBy("cx", "cy").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))]))
    look = labels.withColumn("s", steps).select("cx", "cy", "low", "high", (F.col("cx") + F.col("s.dx")).alias("qx"), (F.col("cy") + F.col("s.dy")).alias("qy"))
    other = labels.select(F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    return look.join(other, ["qx", "qy"]).filter("low <> high or q_low <> q_high or low <> q_low").select("cx", "cy", "qx", "qy")


#: Features that every query is held against for its first bound, and pairs that are tested for it at most.
FIRST, PAIRS = 1 << 13, 1 << 25
#: How many times more features each pass holds against the last one's bounds.
MORE = 8
#: Features that one task places in cells.
TOGETHER = 1 << 15
#: Rows of looked-up cells up to which they are broadcast to the features.
FEW = 1 << 20


def _place_boxes(features: DataFrame, box: tuple[vec.Point, vec.Point], side: int) -> DataFrame:
    for a, low, high in zip("xyz", *box, strict=False):
        features = features.withColumn(f"_g{a}", F.explode(F.sequence(F.floor(low / side).cast("long"), F.floor(high / side).cast("long"))))
    return features


def _within(bounded: DataFrame, features: DataFrame, distance2: Column, position: vec.Point, box: tuple[vec.Point, vec.Point], side: int, place: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """Pairs of queries with a bound _most and features that are no farther; a pair can repeat."""
    axes = "xyz"[: len(position)]
    cell = [f"_g{a}" for a in axes]
    # all features within the bound lie in cells that the ball around the query meets; a little more, for rounding
    reach = F.sqrt("_most") * (1 + 1e-9) + 1e-6
    look = bounded
    for g, c in zip(cell, position, strict=True):
        look = look.withColumn(g, F.explode(F.sequence((F.ceil((c - reach) / side) - 1).cast("long"), F.floor((c + reach) / side).cast("long"))))
    gaps = [F.greatest(F.col(g) * side - c, c - (F.col(g) + 1) * side, F.lit(0)).cast("double") for g, c in zip(cell, position, strict=True)]
    look = write_and_reread(look.filter(vec.length2(tuple(gaps)) <= reach * reach), "nearest-look")
    near = F.broadcast(look) if look.count() <= FEW else look
    apart = [F.greatest(a - c, c - b, F.lit(0)).cast("double") for a, b, c in zip(*box, position, strict=True)]
    # coalescing to as many partitions moves nothing; it parts the step into two that are small enough to be compiled
    return place(features.repartition(parts)).coalesce(parts).join(near, cell).filter(vec.length2(tuple(apart)) <= reach * reach).filter(distance2 <= F.col("_most"))


def nearest(queries: DataFrame, features: DataFrame, distance2, query_key: list[str], position: vec.Point, feature_box: tuple[vec.Point, vec.Point], label: str, tie: list[str], side: int, extra: dict | None = None, place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query key, label, d2, extra...): the nearest feature's label by squared distance; ties by ``tie``, then label.

    ``extra``: name -> expression over query and feature, of the nearest one. ``place``: adds
    the cells (_gx, _gy[, _gz]) that a feature meets; by default those that its box meets.

    Every query is held against a few features, picked by hash, for a bound on its distance; then,
    pass by pass, against MORE times as many: those with a cell that the ball of the bound
    around it meets. The last pass holds all features, and the pairs within the bound, a few for
    each query, are compared in full. Features alone are written; their cells are made anew
    in each pass.
    """
    place = place or (lambda rows: _place_boxes(rows, feature_box, side))
    features = write_and_reread(features, "nearest-features")
    queries = write_and_reread(queries, "nearest-queries")
    n, wanted = features.count(), queries.count()
    if not n or not wanted:
        return queries.select(*query_key).limit(0).crossJoin(features.select(F.col(label).alias("label"), F.lit(0.0).alias("d2"), *[F.lit(None).cast("long").alias(c) for c in extra or {}]).limit(0))
    turn = F.xxhash64(*features.columns)
    share = lambda size: features if size >= n else features.filter(F.pmod(turn, F.lit(-(-n // size))) == 0)
    within = lambda size: _within(bounded, share(size), distance2, position, feature_box, side, place, 1 + min(size, n) // TOGETHER)  # noqa: E731  (a feature can be in many cells)
    size = min(FIRST, max(16, PAIRS // wanted))
    chosen = lambda rows: write_and_reread(place(rows).select(*features.columns).distinct().limit(2 * size), "nearest-first")  # noqa: E731  (those in some cell)
    few = chosen(share(size))
    if few.isEmpty():  # copies are picked together
        few = chosen(features)
    own = list(queries.columns)
    first = queries.repartition(1 + wanted * size // (1 << 21)).crossJoin(F.broadcast(few))
    # a minimum of numbers is kept in a hash table; one of structs would be sorted
    bounded = write_and_reread(first.groupBy(*own).agg(F.min(distance2).alias("_most")), "nearest-bound")
    while size * MORE < n:
        size *= MORE
        found = within(size).groupBy(*own).agg(F.min(distance2).alias("_found"))
        bounded = write_and_reread(bounded.join(found, own, "left").select(*own, F.least("_most", "_found").alias("_most")), "nearest-bound")
    # each pair once; more is worked out for the few that are left
    met = within(n).groupBy(*own, *features.columns).agg(F.min(distance2).alias("_d2"))
    best = met.groupBy(*query_key).agg(F.min(F.struct("_d2", *tie, F.col(label).alias("_label"), *[e.alias(c) for c, e in (extra or {}).items()])).alias("_b"))
    return best.select(*query_key, F.col("_b._label").alias("label"), F.col("_b._d2").alias("d2"), *[F.col(f"_b.{c}").alias(c) for c in extra or {}])


def pick(vertices: DataFrame, at: vec.Point, position: vec.Point, tie: list[str]) -> DataFrame:
    """The row nearest to one point, ties by ``tie``: a partial minimum a task."""
    d2 = vec.length2(vec.sub(position, at)).alias("d2")
    best = vertices.agg(F.min(F.struct(d2, *tie, F.struct(*vertices.columns).alias("row"))).alias("b")).filter("b is not null")
    return best.select("b.row.*", "b.d2")


def ray_pick(triangles: DataFrame, origin: vec.Point, ray: vec.Point) -> DataFrame:
    """The triangle that a ray's line meets at the smallest parameter: prim_id, label, t."""
    hit = geom.ray_hit(origin, ray, vec.point("a", 3), vec.point("b", 3), vec.point("t", 3))
    found = triangles.withColumn("t", hit).filter("t is not null").agg(F.min(F.struct("t", "prim_id", "label")).alias("h"))
    return found.filter("h is not null").select("h.prim_id", "h.label", "h.t")
