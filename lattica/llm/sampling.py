"""Bounded samples that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets that a sample is made of, about, and those that are looked at.
PARTS, SEEN = 8, 16


def hash_sample(rows: DataFrame, hashed: Column, most: int, by: str | None = None) -> DataFrame:
    """At most ``most`` rows (of each value of ``by``) in whole buckets of a hash.

    The number of buckets follows the number of rows, so a bucket holds about an eighth of
    ``most`` at any size, and the driver sees a count and SEEN bucket counts a group. All
    rows are taken where they are no more than ``most``. Rows of one hash value stay
    together; a bucket that is larger than ``most`` alone is passed over.
    """
    keyed = rows.withColumn("_by", F.col(by) if by else F.lit(""))
    sizes = {r["_by"]: r["count"] for r in keyed.groupBy("_by").count().collect()}
    if not sizes:
        return rows.limit(0)
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("_by")]
    buckets = of({k: max(1, -(-PARTS * n // most)) for k, n in sizes.items()})
    dealt = keyed.withColumn("_bucket", F.pmod(hashed, buckets)).filter(F.col("_bucket") < SEEN)
    taken, chosen, closed = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), set()
    for r in dealt.groupBy("_by", "_bucket").count().orderBy("_bucket").collect():
        name, n = r["_by"], r["count"]
        if n > most:
            continue
        if name in closed or taken[name] + n > most:
            closed.add(name)
            continue
        taken[name], chosen[name] = taken[name] + n, chosen[name] | 1 << r["_bucket"]
    bit = F.pow(F.lit(2), F.col("_bucket")).cast("int")
    return dealt.filter(of(chosen).bitwiseAND(bit) != 0).drop("_by", "_bucket")
