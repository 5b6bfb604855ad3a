"""Graph operators over edge tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lattica.functions import pairs
from lattica.operators.stats import prefix_sum
from lattica.session import discard, scratched, shuffles_freed, write_and_reread


#: Edges that one task handles alone, about 16 MB of them.
FEW = 1 << 20
#: Edges of which one task finds the lightest, and paths of which one task finds a ring's new nodes.
LIGHT, ROWS = 1 << 19, 1 << 22
#: Paths to a ring that are made at once, at least.
PATHS = 1 << 27


def smallest_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that each is linked with, by pairs u, v."""
    label = np.arange(n)
    while True:
        one, two = label[u], label[v]
        low, high = np.minimum(one, two), np.maximum(one, two)
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while True:  # to the roots
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of edges."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    both = pa.chunked_array([b.column(i) for i in (0, 1) for b in held])
    values = both.to_numpy()
    names, at = np.unique(values, return_inverse=True)
    half = len(values) // 2
    label = smallest_labels(at[:half], at[half:], len(names))
    for low in range(0, len(names), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(names[part], both.type), pa.array(names[label[part]], both.type)], ["node", "component"])


@scratched
def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Up to ``few`` distinct edges go to one task. Beyond, each round every node adopts its smallest neighbour, if that is smaller; the adopted
    labels are followed to their roots, halving the way each time; and the edges are
    rewritten to labels, so edges inside a component vanish. Labels only decrease and a
    component's smallest node keeps its own, so the last label is the smallest node. Each
    round at least halves the labels of a component, so rounds and steps are logarithmic. Each
    round's tables are written to the shared folder, so a lost executor costs one round.
    Null ends and loops are ignored; an empty table gives no rows.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    links = write_and_reread(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    if links.count() <= few:
        kind = links.schema["u"].dataType.simpleString()
        return write_and_reread(links.coalesce(1).mapInArrow(_one_task, f"node {kind}, component {kind}"), "cc-labels")
    labels = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        least = write_and_reread(least, "cc-least")
        jump = least
        for _ in range(max_rounds):  # to the roots of the adopted labels; the distance halves each time
            up = jump.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jump = write_and_reread(jump.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved")), "cc-jump")
            if jump.filter("moved").isEmpty():
                break
            jump = jump.select("u", "p")
        follow = jump.select(F.col("u").alias("component"), "p")
        labels = write_and_reread(labels.join(follow, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
        ends = links.join(jump, "u").select(F.col("p").alias("a"), "v").join(jump.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        links = write_and_reread(ends.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
        if links.isEmpty():
            return labels
    raise RuntimeError(f"connected_components did not converge in {max_rounds} rounds")


def undirected(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Both directions of each distinct edge, without loops."""
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    return one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def graph_from_segments(segments: DataFrame, bucket: int = 256) -> tuple[DataFrame, DataFrame]:
    """(vertices id, x, y; edges u, v): equal points are one vertex, numbered by (x, y), and equal edges one edge."""
    ends = segments.select(F.explode(F.array(*[F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab"])).alias("e")).select("e.*").distinct()
    vertices = prefix_sum(ends.withColumn("one", F.lit(1).cast("long")), "one", F.floor(F.col("x") / bucket), ["x", "y"], "id").select("id", "x", "y")
    named = segments.select("ax", "ay", "bx", "by")
    for p, to in (("a", "u"), ("b", "v")):
        named = named.join(vertices.select(F.col("id").alias(to), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")), [f"{p}x", f"{p}y"])
    return vertices, named.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def network_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that only one of two networks has, counted as often as they are too many; none if they are equal."""
    return one.exceptAll(two).unionAll(two.exceptAll(one))


def _by_first(rows: DataFrame, name: str) -> DataFrame:
    """(one, first, width, steps): the second numbers of each first one, packed; a very long list in several rows."""
    one = rows.columns[0]
    dealt = rows.repartition(1 + rows.count() // FEW, one).sortWithinPartitions(one)
    return write_and_reread(dealt.mapInArrow(pairs.pack(False), pairs.SCHEMA).drop("known"), name)


def _next_ring(last: DataFrame, near: DataFrame, known: list[DataFrame], sizes: bool) -> DataFrame:
    """(center, node), or with sizes (center, n), written: what the last ring's neighbours add to each centre.

    The paths may outnumber the links by far, so centres take turns, each of about PATHS paths, or twice the links if that is more; what
    a turn shuffles is gone before the next.
    """
    lists = ["first", "width", "steps"]
    centres = _by_first(last.select("node", "center").dropna(), "rings-centres")
    both = centres.join(near.withColumnsRenamed({c: f"{c}_2" for c in lists}), "one")
    many = [F.expr(f"length(steps{s}) div width{s}") for s in ("", "_2")]
    links = near.agg(F.sum(F.expr("length(steps) div width"))).first()[0] or 0
    with shuffles_freed(near.sparkSession):
        number = both.agg(F.sum(many[0] * many[1])).first()[0] or 0
    turns = 1 + number // max(PATHS, 2 * links)
    schema = "center long, n long" if sizes else "center long, node long"
    parts = []
    for turn in range(turns):
        rows = both.select(*lists, *[f"{c}_2" for c in lists]).mapInArrow(pairs.paths(turns, turn), pairs.SCHEMA)
        for held in known:
            rows = rows.unionAll(held.select("center", "node").dropna().mapInArrow(pairs.pack(True, turns, turn), pairs.SCHEMA))
        dealt = rows.repartition(1 + number // turns // ROWS, "one").sortWithinPartitions("one")
        parts.append(write_and_reread(dealt.mapInArrow(pairs.fresh(schema.replace(" long", "").split(", "), sizes), schema), "rings"))
    discard(centres)
    return functools.reduce(DataFrame.unionAll, parts)


def _rings(edges: DataFrame, sources: DataFrame, max_ring: int, node: str, sizes: bool) -> Iterator[tuple[DataFrame, int]]:
    """Each ring with its number, as rows (center, node); with sizes the last one as rows (center, n)."""
    last = sources.select(F.col(node).alias("center"), F.col(node).alias("node")).distinct()
    kinds = [last.schema["node"].dataType, edges.schema["v"].dataType]
    whole = all(isinstance(kind, IntegralType) for kind in [*kinds, edges.schema["u"].dataType])
    last = write_and_reread(last, "rings-sources")
    yield last, 0
    before, near = last.limit(0), None
    if whole:
        ways = [edges.select(a, b).filter("u <> v") for a, b in ("uv", "vu")]
        near = functools.reduce(DataFrame.unionAll, [_by_first(way, "rings-near") for way in ways])
    else:
        links = write_and_reread(undirected(edges), "rings-links")
    for k in range(1, max_ring + 1):
        if whole:
            found = _next_ring(last, near, [last, before] if k > 1 else [last], sizes and k == max_ring)
            fresh = found.withColumn("center", F.col("center").cast(kinds[0]))
            if "node" in fresh.columns:
                fresh = fresh.withColumn("node", F.col("node").cast(kinds[1]))
        else:
            paths = last.join(links.withColumnRenamed("u", "node"), "node").select("center", F.col("v").alias("node"))
            fresh = write_and_reread(paths.distinct().join(last, ["center", "node"], "left_anti").join(before, ["center", "node"], "left_anti"), "rings")
        before, last = last, fresh
        if last.isEmpty():
            break
        yield last, k


def k_rings(edges: DataFrame, sources: DataFrame, max_ring: int, node: str = "node") -> DataFrame:
    """(center, node, ring): nodes at graph distance 0..max_ring from each source.

    A ring is what its last ring's neighbours add, less the last two rings. Paths to a ring outnumber its nodes by far;
    where nodes are whole numbers, lists of centres and of neighbours meet node by node, and the paths move packed by
    their centre, where they meet the last two rings. ``edges`` are read several times.
    """
    rings = [rows.withColumn("ring", F.lit(k)) for rows, k in _rings(edges, sources, max_ring, node, False)]
    return functools.reduce(DataFrame.unionByName, rings)


def ring_sizes(edges: DataFrame, sources: DataFrame, max_ring: int, node: str = "node") -> DataFrame:
    """(center, ring, n): how many nodes ``k_rings`` has of each ring. Those of the last and largest ring are counted where they are made, and not written."""
    parts = []
    for rows, k in _rings(edges, sources, max_ring, node, True):
        told = rows if "n" in rows.columns else rows.groupBy("center").agg(F.count(F.lit(1)).alias("n"))
        parts.append(told.select("center", F.lit(k).alias("ring"), "n"))
    return functools.reduce(DataFrame.unionAll, parts)


@scratched
def shortest_paths(edges: DataFrame, source, max_rounds: int | None = None) -> DataFrame:
    """(node, cost, parent): cheapest cost from ``source`` over undirected weighted edges (u, v, w).

    Frontier relaxation: only nodes whose cost fell pass it on. Ties of a cost keep the
    smallest parent. Weights must not be negative. A round passes costs on by one edge, so
    there are as many as the longest cheapest path has edges; ``max_rounds`` is a bound for
    callers that want one.
    """
    spark = edges.sparkSession
    # each edge once, dealt to as many tasks as the edges need, and turned both ways when the lightest is known
    one = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    one = write_and_reread(one, "path-edges")
    one = one.repartition(1 + one.count() // LIGHT, "u", "v").groupBy("u", "v").agg(F.min("w").alias("w"))
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    links = write_and_reread(one.select(ways.alias("e"), "w").select("e.u", "e.v", "w"), "path-links")
    kind, cost = links.schema["u"].dataType.simpleString(), links.schema["w"].dataType.simpleString()
    state = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0).cast(cost).alias("cost"), F.lit(None).cast(kind).alias("parent"))
    frontier = state = write_and_reread(state, "path-state")
    turn = 0
    while max_rounds is None or turn < max_rounds:
        turn += 1
        offers = frontier.join(links.withColumnRenamed("u", "node"), "node").select(F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("node").alias("parent"))
        best = offers.groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("o"))
        held = state.select("node", F.col("cost").alias("old"), F.col("parent").alias("old_parent"))
        better = best.join(held, "node", "left").filter("old is null or o.cost < old or (o.cost = old and o.parent < old_parent)")
        frontier = write_and_reread(better.select("node", "o.cost", "o.parent"), "path-frontier")
        if frontier.isEmpty():
            return state
        state = write_and_reread(state.join(frontier.select("node"), "node", "left_anti").unionByName(frontier), "path-state")
    raise RuntimeError(f"shortest_paths did not converge in {max_rounds} rounds")


def path_to(paths: DataFrame, target) -> list:
    """Nodes from the target back to the source; empty if it cannot be reached. A path's length of lookups."""
    out, at = [], target
    while at is not None:
        row = paths.filter(F.col("node") == F.lit(at)).first()
        if row is None:
            return []
        out.append(row["node"])
        at = row["parent"]
    return out
