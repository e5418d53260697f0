"""Per-key results when a few keys own most rows.

Rows are range-partitioned on the composite (key, secondary order) with Spark's sampled quantiles, so a heavy key is cut into as many
partitions as its size asks for and every task gets about the same number of rows. Each partition then reduces its contiguous stretch to
one partial state per key; only these states meet again, and the states of a key that crosses a partition boundary are stitched
(merged) in the final, tiny, aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import materialize

#: Names of the working columns; input columns are renamed away from them, so tables may have columns of these names.
_KEY, _ORDER = "__key", "__order"


def range_cut(df: DataFrame, key: Column, order: Sequence[Column], carry: Mapping[str, Column], partitions: int | None = None) -> DataFrame:
    """``key`` (as ``__key``) and the ``carry`` columns, range-partitioned on (key, order).

    ``order`` must be fine enough to cut the heaviest key; a hash of the row's own identity is a good last entry. Without ``partitions``
    the session's shuffle partitions apply and adaptive execution may merge small ones.
    """
    picked = df.select(key.alias(_KEY), *[c.alias(f"{_ORDER}{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in carry.items()])
    by = [_KEY, *[f"{_ORDER}{i}" for i in range(len(order))]]
    cut = picked.repartitionByRange(partitions, *by) if partitions else picked.repartitionByRange(*by)
    return cut.drop(*by[1:])


def count_by_key(df: DataFrame, key: Column, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """(``key_value``, ``n_rows``) for every value of ``key``, null included as one group; an empty table gives no rows."""
    cut = range_cut(df, key, order, {}, partitions)
    # map-side hash aggregation makes one partial state per key and partition; the exchange carries only those
    return cut.groupBy(F.col(_KEY).alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"))


def sum_sparse_by_key(
    df: DataFrame, key: Column, order: Sequence[Column], items: Column, amounts: Column, skip: Sequence[int] = (1,), partitions: int | None = None
) -> DataFrame:
    """(``key_value``, ``gene``, ``total``, ``n_cells``): sums of a pair of parallel arrays per key and item.

    The row (not the exploded pair) travels through the range shuffle; arrays are unfolded inside the partition and reduced there. Arrays of unequal
    length are padded with nulls; a null item or amount adds nothing. ``skip`` lists marker items.
    """
    cut = range_cut(df, key, order, {"__items": items, "__amounts": amounts}, partitions)
    pairs = cut.select(_KEY, F.inline(F.arrays_zip(F.col("__items").alias("gene"), F.col("__amounts").alias("amount"))))
    kept = pairs.filter(F.col("gene").isNotNull() & F.col("amount").isNotNull() & ~F.col("gene").isin(*skip))
    return kept.groupBy(F.col(_KEY).alias("key_value"), "gene").agg(
        F.sum(F.col("amount").cast("double")).alias("total"), F.count(F.lit(1)).alias("n_cells")
    )


def heavy_keys(df: DataFrame, fields: Mapping[str, Column], one_in: int, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """(``key_field``, ``key_value``, ``n_rows``, ``total_rows``) of each non-null value that holds at least one in ``one_in`` of all rows.

    All fields are counted in one pass: the field's name is the first part of the composite key. The total counts every row once, null keys
    included. Exact at every size; nothing is sampled but the range bounds.
    """
    names = list(fields)
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("field"), fields[n].alias("value")) for n in names])).alias("kv"),
        *[c.alias(f"o{i}") for i, c in enumerate(order)],
    )
    counted = count_by_key(long, F.col("kv"), [F.col(f"o{i}") for i in range(len(order))], partitions).select("key_value.field", "key_value.value", "n_rows")
    # one row per value; written once, as it is read twice
    counted = materialize(counted, "key-counts")
    # the number of rows is the sum of one field's groups, the null group included
    total = counted.filter(F.col("field") == names[0]).agg(F.sum("n_rows")).first()[0] or 0
    heavy = counted.filter(F.col("value").isNotNull() & (F.col("n_rows") * one_in >= total))
    return heavy.select(F.col("field").alias("key_field"), F.col("value").alias("key_value"), "n_rows", F.lit(total).cast("long").alias("total_rows"))


def join_heavy(rows: DataFrame, labels: DataFrame, key: str, counts: DataFrame | None = None, one_in: int = 512) -> DataFrame:
    """Left join of ``rows`` with ``labels`` (one row per ``key``) that no heavy key can hold up.

    A key with at least one in ``one_in`` of all rows is heavy: there are at most ``one_in`` of them, so their labels are broadcast and their rows stay where they are. All others meet
    in a shuffle join, where no key is large. ``counts`` (``key``, ``n_rows``) saves a pass where the caller has it. A null key gets no label; both sides may be empty."""
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = materialize(counts.filter(F.col(key).isNotNull()).select(key, "n_rows"), "join-counts")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    heavy = F.broadcast(counts.filter(F.col("n_rows") * one_in >= total).select(key))
    near = rows.join(heavy, key, "left_semi").join(F.broadcast(labels.join(heavy, key, "left_semi")), key, "left")
    rest = rows.join(heavy, key, "left_anti").join(labels, key, "left")
    return near.unionByName(rest)


def places(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``place``, the number (from 0) of the row in the order of ``value`` within its ``keys``, and ``group_rows``; no group is ever in one task.

    Rows are range-partitioned on (keys, value) and written with the partition they came to. Rows of a group are numbered within each partition, and what the group has in the partitions before is
    added. Equal values take neighbouring places in any order. Null keys form groups; null values come first."""
    cut = materialize(df.repartitionByRange(*keys, value).withColumn("__cut", F.spark_partition_id()), "places")
    # as many rows as there are groups, and partitions that cut one
    counts = cut.groupBy("__cut", *keys).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    before = counts.select(
        F.col("__cut").alias("__c"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.sum("__n").over(group.orderBy("__cut")) - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("group_rows")
    )
    same = F.col("__cut") == F.col("__c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = cut.withColumn("__nth", F.row_number().over(Window.partitionBy("__cut", *keys).orderBy(value)) - 1)
    return numbered.join(before, same).withColumn("place", F.col("__before") + F.col("__nth")).select(*df.columns, "place", "group_rows")


def exact_percentiles(placed: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """(keys..., one column per entry of ``at``) of rows numbered by :func:`places`, interpolated between neighbours as in SQL's percentile_cont."""
    out = placed.groupBy(*keys)
    columns = []
    for name, q in at.items():
        rank = F.lit(q) * (F.col("group_rows") - 1)
        low, share = F.floor(rank), rank - F.floor(rank)
        weight = F.when(F.col("place") == low, 1 - share).when(F.col("place") == low + 1, share)
        columns.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return out.agg(*columns)
