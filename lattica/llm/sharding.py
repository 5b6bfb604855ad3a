"""Balanced label propagation: documents into shards of equal counts, linked documents together.

Documents that share a link value (equal texts, in the registered query) form a group;
the group stands for the links between its members, so that none is written out. The
state is a row for each group and shard with the number of members there, never a row a
link. A document starts in a shard by hash. Each round joins the state with each group's
label, the shard that holds most of it (a group larger than a shard has as many labels
as it needs shards), and members move there under quotas: for each
pair of shards the demand is summed, and the flows are scaled so that no shard leaves
its capacity. At the end shards give up what exceeds their exact count, whole groups
where they can, and singles and the released members fill the rest.

The law is ``rows``: counts of the shards differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import scratched, write_and_reread

#: Rows of a group that one task ranks at most, about.
CHUNK = 20_000


def running_total(rows: DataFrame, value: str, keys: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, in an order by hash, for each key.

    Rows are dealt into buckets by the hash of ``order``, which has to be unique; sums of
    whole buckets are carried over, so no task ranks more than a bucket of a key.
    """
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(7), *order), F.lit(buckets)))
    sums = dealt.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ranked.join(sums, [*keys, "_b"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def quotas(demand: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Share of each demanded flow (from, to) that keeps every shard between its bounds."""
    flow = demand.astype(float).copy()
    for _ in range(rounds):
        out, into = flow.sum(1), flow.sum(0)
        over = np.maximum(size - out + into - high, 0)
        under = np.maximum(low - (size - out + into), 0)
        if over.sum() + under.sum() < 1e-9:
            break
        flow *= (1 - np.minimum(over / np.maximum(into, 1e-9), 1))[None, :]
        flow *= (1 - np.minimum(under / np.maximum(out, 1e-9), 1))[:, None]
    return np.divide(flow, demand, out=np.zeros_like(flow), where=demand > 0)


def _map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _propagate(state: DataFrame, shards: int, targets: np.ndarray, sizes: np.ndarray, rounds: int, slack: float) -> DataFrame:
    """Rounds of label propagation over (grp, shard, n); the table has a row per group and shard."""
    low, high = np.zeros(shards), targets * (1 + slack)  # singles fill what the groups leave
    for turn in range(rounds):
        # a group's labels are its strongest shards, as many as it needs; the group's hash breaks ties
        own = Window.partitionBy("grp")
        ranked = state.withColumn("r", F.row_number().over(own.orderBy(F.desc("n"), F.xxhash64("grp", "shard"), "shard")) - 1)
        ranked = ranked.withColumn("k", F.ceil(F.sum("n").over(own) / F.lit(float(max(targets.min(), 1.0)))))
        ranked = write_and_reread(ranked.withColumn("pick", F.when(F.col("r") < F.col("k"), F.col("r")).otherwise((F.col("r") + turn) % F.col("k"))), "shard-ranked")
        label = ranked.filter("r < k").select("grp", F.col("r").alias("pick"), F.col("shard").alias("label"))
        wish = write_and_reread(ranked.join(label, ["grp", "pick"]).select("grp", "shard", "n", "label"), "shard-wish")
        moved = np.zeros((shards, shards))
        for r in wish.filter("shard <> label").groupBy("shard", "label").agg(F.sum("n").alias("n")).collect():  # shards**2 rows
            moved[r["shard"], r["label"]] = r["n"]
        if not moved.any():
            break
        share = quotas(moved, sizes, low, high)
        open_pairs = {a * shards + b: float(share[a, b]) for a in range(shards) for b in range(shards) if share[a, b] > 0}
        if not open_pairs:
            break
        quota = F.coalesce(_map_of(open_pairs)[F.col("shard") * shards + F.col("label")], F.lit(0.0))
        luck = (F.pmod(F.xxhash64("grp", "shard", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)).cast("double")
        go = F.when(F.col("shard") == F.col("label"), F.lit(0)).when(F.col("n") <= CHUNK // 100, F.when(luck < quota, F.col("n")).otherwise(0)).otherwise(F.floor(F.col("n") * quota))
        went = wish.withColumn("go", go.cast("long"))
        parts = F.explode(F.array(F.struct(F.col("shard").alias("s"), (F.col("n") - F.col("go")).alias("m")), F.struct(F.col("label").alias("s"), F.col("go").alias("m"))))
        after = went.select("grp", parts.alias("p")).filter("p.m > 0").groupBy("grp", F.col("p.s").alias("shard")).agg(F.sum("p.m").alias("n"))
        state = write_and_reread(after, "shard-state")
        sizes = sizes + 0.0
        for r in went.filter("go > 0").groupBy("shard", "label").agg(F.sum("go").alias("n")).collect():
            sizes[r["shard"]] -= r["n"]
            sizes[r["label"]] += r["n"]
    return state


@scratched
def assign_shards(docs: DataFrame, link: Column, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6, slack: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with the same value of ``link`` are linked; a null link value is its own
    group. Counts of shards differ by one at most, slots are gapless from 0 in each shard,
    and grown_shard is null under this law. A null text has size 8 and checksum 0, like an
    empty one. Rows that repeat an id, or are equal in every column, are documents of
    their own (ranked by what they hold, then by position). A null id is kept. An empty
    table gives no rows. Other columns don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), link.alias("_link"))
    place = F.monotonically_increasing_id()
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce(F.col("_link").cast("string"), F.concat(F.lit("null-"), F.col("doc_id").cast("string"), F.lit("-"), place.cast("string"))).alias("grp"), place.alias("at"))
    rows = write_and_reread(rows, "shard-rows")  # positions have to stay as they are
    total = rows.count()
    salts = shards * max(1, -(-total // (CHUNK * shards)))
    buckets = max(16, -(-total // CHUNK))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(salts)).cast("int"))
    base = total // shards
    targets = np.array([base + (s < total % shards) for s in range(shards)], float)

    # members of each group by salt, and each salt's first rank in its group
    chunks = rows.groupBy("grp", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("grp").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    chunks = chunks.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("members", F.sum("n").over(whole))
    chunks = write_and_reread(chunks, "shard-chunks")

    first = chunks.filter("members > 1").groupBy("grp", F.pmod("salt", F.lit(shards)).alias("shard")).agg(F.sum("n").alias("n"))
    sizes = np.zeros(shards)  # members of groups only: singles can go anywhere
    start = write_and_reread(first, "shard-start")
    for r in start.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        sizes[r["shard"]] += r["n"]
    state = _propagate(start, shards, targets, sizes, rounds, slack)

    # shards keep their groups up to their exact count and release the rest
    most = _map_of({s: int(targets[s]) for s in range(shards)})
    held = running_total(state, "n", ["shard"], ["grp"], buckets, "before")
    held = held.withColumn("keep", F.greatest(F.least(F.col("n"), most[F.col("shard")] - F.col("before")), F.lit(0)))
    held = write_and_reread(held.select("grp", "shard", "n", "keep"), "shard-held")
    kept = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("keep").alias("n")).collect()}
    free = np.array([int(targets[s]) - (kept.get(s) or 0) for s in range(shards)])
    ends = np.cumsum(free)

    released = held.filter("n > keep").groupBy("grp").agg(F.sum(F.col("n") - F.col("keep")).alias("n"))
    pool = chunks.filter("members = 1").select("grp", "n").unionAll(released)
    pool = running_total(pool, "n", [], ["grp"], buckets, "low") if total else pool.withColumn("low", F.lit(0))
    gaps = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(int(ends[s] - free[s])).alias("low"), F.lit(int(ends[s])).alias("high")) for s in range(shards)])
    cut = pool.select("grp", F.explode(F.filter(F.transform(gaps, lambda g: F.struct(g["shard"].alias("shard"), (F.least(g["high"], F.col("low") + F.col("n")) - F.greatest(g["low"], F.col("low"))).alias("n"))), lambda x: x["n"] > 0)).alias("p"))
    parts = held.filter("keep > 0").select("grp", "shard", F.col("keep").alias("n"), F.lit(0).alias("late")).unionAll(cut.select("grp", F.col("p.shard"), F.col("p.n"), F.lit(1).alias("late")))
    parts = write_and_reread(parts, "shard-parts")

    # slots of each part in its shard, and the ranks in the group that it takes
    parts = running_total(parts, "n", ["shard"], ["grp", "late"], buckets, "slot")
    inside = Window.partitionBy("grp").orderBy("late", "shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("low", F.coalesce(F.sum("n").over(inside), F.lit(0))).select("grp", "shard", "slot", "low", (F.col("low") + F.col("n")).alias("high"))
    pieces = chunks.alias("c").join(parts.alias("p"), F.expr("c.grp = p.grp and p.low < c.base + c.n and c.base < p.high"))
    pieces = pieces.select("c.grp", "c.salt", "p.shard", (F.col("p.low") - F.col("c.base")).alias("low"), (F.col("p.high") - F.col("c.base")).alias("high"), F.col("p.slot"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy("doc_id", "at")) - 1)
    placed = ranked.join(pieces, ["grp", "salt"]).filter("rank >= low and rank < high")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("rank") - F.col("low")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def equal_texts(text_col: str = "text") -> Column:
    """Link value of the registered query: equal texts (null as empty) are linked."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
