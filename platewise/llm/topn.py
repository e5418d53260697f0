"""The N best items of every group, however many candidates a group has.

A histogram of the scores per group, made in one map-side combined pass, gives a threshold that leaves at least N different items; rows beyond it are dropped where
they are read, and only the few survivors are ranked exactly with the full tie rule.

Different items (not rows) must survive, so every bin keeps maps of 64 bits of item hashes instead of a count: the set bits of the union over the best
bins never exceed the number of different items in them, which makes the threshold safe even when items repeat. A larger N takes more maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.skew import join_heavy
from platewise.session import materialize

#: A map of 64 bits tells this many items apart without filling up.
ITEMS_PER_MAP = 32


def score_bin(primary: Column, secondary: Column) -> Column:
    """A bin number that grows with (primary ascending, secondary descending) and never puts a better row above a worse one.

    Positive primaries get eight bins a power of two. Exact zeros, the usual mass of ties, are split further by the secondary score.
    """
    fine = F.least(F.greatest(F.floor(F.log2(secondary) * 8), F.lit(-2000)), F.lit(2000))
    zero = F.when(secondary > 0, -fine).otherwise(F.lit(2001))  # larger secondary first
    positive = F.least(F.greatest(F.floor(F.log2(primary) * 8), F.lit(-8600)), F.lit(8600)) + 20_000
    return F.when(primary > 0, positive).when(primary == 0, zero).otherwise(F.lit(-20_000)).cast("int")


def thresholds(rows: DataFrame, n: int) -> DataFrame:
    """(``g``, ``last``, ``n_rows``): the worst bin that has to be kept for group ``g``, and its rows; groups with too few items keep everything."""
    maps = -(-n // ITEMS_PER_MAP)
    at = F.pmod(F.xxhash64("item"), F.lit(64 * maps))
    bits = F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) as int)))")
    histogram = rows.select("g", "bin", at.alias("at")).groupBy("g", "bin", F.floor(F.col("at") / 64).cast("int").alias("map")).agg(bits.alias("seen"), F.count(F.lit(1)).alias("rows"))
    # a group has at most some thousand bins per map, whatever its number of rows; from here on everything stays with its group
    upto = Window.partitionBy("g", "map").orderBy("bin")
    union = F.expr("bit_count(bit_or(seen) over (partition by g, map order by bin rows between unbounded preceding and current row))")
    known = histogram.repartition("g").withColumn("upto", union).withColumn("new", F.col("upto") - F.coalesce(F.lag("upto").over(upto), F.lit(0)))
    bins = known.groupBy("g", "bin").agg(F.sum("new").alias("new"), F.sum("rows").alias("rows"))
    enough = bins.withColumn("items", F.sum("new").over(Window.partitionBy("g").orderBy("bin")))
    return enough.groupBy("g").agg(F.coalesce(F.min(F.when(F.col("items") >= n, F.col("bin"))), F.lit(2**31 - 1)).alias("last"), F.sum("rows").alias("n_rows"))


def top_items(
    df: DataFrame, group: Column, item: Column, primary: Column, secondary: Column, n: int = 10, carry: Sequence[str] = (), broadcast_groups: int = 200_000
) -> DataFrame:
    """(``g``, ``item``, ``primary``, ``secondary``, carry..., ``nth``): per group the ``n`` first items by smaller primary, larger secondary, item ascending (byte order).

    An item counts once per group, by its best row. Rows with a null group or item, or a null or NaN score, do not compete. Carried columns come from the
    best row (smallest value among exact ties). Thresholds are broadcast up to ``broadcast_groups`` groups (some MB); with more groups only those of heavy groups are, and the
    rows of all others meet theirs in a shuffle join. Groups with fewer than ``n`` items come back whole; an empty table gives no rows.
    """
    rows = df.select(
        group.alias("g"), item.alias("item"), primary.cast("double").alias("primary"), secondary.cast("double").alias("secondary"), *[F.col(c).alias(f"c_{c}") for c in carry]
    ).filter("g is not null and item is not null and primary is not null and secondary is not null and not isnan(primary) and not isnan(secondary)")
    binned = rows.withColumn("bin", score_bin(F.col("primary"), F.col("secondary")))
    limits = materialize(thresholds(binned.select("g", "bin", "item"), n), "topn-thresholds")
    if limits.limit(broadcast_groups + 1).count() <= broadcast_groups:
        limited = binned.join(F.broadcast(limits.select("g", "last")), "g")
    else:
        limited = join_heavy(binned, limits.select("g", "last"), "g", limits.select("g", "n_rows"))
    survivors = limited.filter("bin <= last")
    extra = [f"c_{c}" for c in carry]
    best = survivors.groupBy("g", "item").agg(F.min(F.struct(F.col("primary"), (-F.col("secondary")).alias("less"), *extra)).alias("best"))
    flat = best.select("g", "item", F.col("best.primary").alias("primary"), (-F.col("best.less")).alias("secondary"), *[F.col(f"best.{e}").alias(c) for e, c in zip(extra, carry)])
    # ranked with a per-partition group limit before the exchange, so ties by the million cost no memory
    order = Window.partitionBy("g").orderBy(F.col("primary"), F.col("secondary").desc(), F.col("item"))
    return flat.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
