"""Very many small fragments into few files of even size.

1. The two clustering keys (plate, sample) are mapped to coordinates of a 2^order x 2^order grid, and the grid cell to its place on the Hilbert
   curve, so that rows of one plate, and of one sample, lie close together.
2. An exact histogram of the codes (at most 4^MOST_ORDER rows) is accumulated along the curve; every code gets its stretch of the output files. A code with more rows
   than a file holds is cut by the hash of the row's identity, so copies of one cell always meet in one file.
3. Whole rows are shuffled once, straight to the file the histogram gives them (no sampled bounds); there each cell is kept once and the file is written in order.
   Beside it stands, for every cell that came in several fragments, one row per fragment: where its copies were.
4. Source and destination are compared by row count and order-free row digests. What the source ought to keep is worked out from keys and row hashes alone, by
   another way than the files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.text import lower_key, plate_key
from platewise.session import materialize, scratch_path

#: A finer grid has more codes than one ordered accumulation should hold; 4^10 are about a million.
MOST_ORDER = 10


def hilbert_index(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """Place of the cells (x, y) of a 2^order grid on the Hilbert curve; neighbours on the curve are neighbours in the grid."""
    x, y = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
    place = np.zeros(len(x), dtype=np.int64)
    side = 1 << (order - 1)
    while side:
        right, upper = (x & side) != 0, (y & side) != 0
        place = place * 4 + np.where(right, np.where(upper, 2, 3), np.where(upper, 1, 0))
        x, y = x & (side - 1), y & (side - 1)
        turned, flipped = ~upper, ~upper & right
        x, y = np.where(flipped, side - 1 - x, x), np.where(flipped, side - 1 - y, y)
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        side >>= 1
    return place


@dataclass(frozen=True)
class Cell:
    """What identifies a cell; a row where one of the three is null is nobody's copy."""

    plate: Column
    sample: Column
    barcode: Column

    @staticmethod
    def of(plate: str = "plate", sample: str = "sample", barcode: str = "barcode_sub_lib_id") -> Cell:
        return Cell(plate_key(plate), lower_key(sample), lower_key(barcode))


IDENTITY = ["plate", "sample", "barcode"]


def _coordinate(value: Column, order: int) -> Column:
    """A grid coordinate: the trailing number of the key where there is one (keeps the order of plates and samples), else a hash; null is 0."""
    digits = F.regexp_extract(value, r"(\d{1,9})$", 1)
    side = 1 << order
    return F.coalesce(F.when(digits != "", F.pmod(digits.cast("bigint"), F.lit(side))).otherwise(F.pmod(F.xxhash64(value), F.lit(side))), F.lit(0)).cast("int")


@dataclass(frozen=True)
class Layout:
    """Where every row goes: the stretch of each occupied code along the curve (``x, y, rows, before``), and the number of files."""

    spans: DataFrame
    files: int
    rows_per_file: int
    order: int

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``plate, sample, spread``) with ``file``. A code that fits into one file is not cut."""
        fraction = F.pmod(F.col("spread"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        place = F.when(F.col("s.rows") > self.rows_per_file // 2, F.col("s.before") + F.floor(fraction * F.col("s.rows"))).otherwise(F.col("s.before"))
        file = F.greatest(F.least(F.floor(place / F.lit(self.rows_per_file)), F.lit(self.files - 1)), F.lit(0)).cast("int")
        coded = rows.withColumns({"x": _coordinate(F.col("plate"), self.order), "y": _coordinate(F.col("sample"), self.order)}).alias("r")
        # the spans are bounded by 4^MOST_ORDER codes
        joined = coded.join(F.broadcast(self.spans.alias("s")), (F.col("r.x") == F.col("s.x")) & (F.col("r.y") == F.col("s.y")))
        return joined.select(*[F.col(f"r.{c}") for c in rows.columns], file.alias("file"))


def layout(counts: DataFrame, rows_per_file: int) -> Layout:
    """The layout of rows counted per (``plate``, ``sample``, ``n``). The grid is as fine as the number of different keys asks for, up to ``MOST_ORDER``."""
    counts = materialize(counts.groupBy("plate", "sample").agg(F.sum("n").alias("n")), "layout-counts")
    keys = counts.agg(F.countDistinct("plate"), F.countDistinct("sample"), F.sum("n")).first()
    order = max(1, min(MOST_ORDER, math.ceil(math.log2(max(2, keys[0], keys[1])))))
    files = max(1, math.ceil((keys[2] or 0) / rows_per_file))

    @F.pandas_udf("long")
    def code(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(x.to_numpy(), y.to_numpy(), order))

    histogram = counts.groupBy(_coordinate(F.col("plate"), order).alias("x"), _coordinate(F.col("sample"), order).alias("y")).agg(F.sum("n").alias("rows")).withColumn("code", code("x", "y"))
    spans = histogram.withColumn("before", F.sum("rows").over(Window.orderBy("code")) - F.col("rows")).drop("code")
    return Layout(materialize(spans, "layout-spans"), files, rows_per_file, order)


def row_digest(content: str = "content", check: str = "check") -> list[Column]:
    """Order-free digest of a set of rows: how many, and two independent sums of row hashes (as exact decimals, so no overflow)."""
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col(content).cast("decimal(38,0)")), F.lit(0)).alias("digest_a"),
        F.coalesce(F.sum(F.col(check).cast("decimal(38,0)")), F.lit(0)).alias("digest_b"),
    ]


def _keyed(df: DataFrame, cell: Cell, arrived: str, fragment: str) -> DataFrame:
    """The row as one struct (so no column of ``df`` can clash) beside its identity, fragment, arrival, hashes and ``spread``, an even number that copies share."""
    content = F.xxhash64(*df.columns)
    keyed = df.select(
        F.struct(*df.columns).alias("row"), cell.plate.alias("plate"), cell.sample.alias("sample"), cell.barcode.alias("barcode"), F.col(fragment).alias("shard"), F.col(arrived).alias("arrived"),
        content.alias("content"), F.hash(*df.columns).alias("check"),
    )
    whole = F.col("plate").isNotNull() & F.col("sample").isNotNull() & F.col("barcode").isNotNull()
    return keyed.withColumn("whole", whole).withColumn("spread", F.when(F.col("whole"), F.xxhash64(*IDENTITY)).otherwise(F.xxhash64("content", "shard")))


def _arrival(arrived: str = "arrived", shard: str = "shard") -> list[Column]:
    """The order in which copies of a cell are preferred, nulls last."""
    return [F.col(arrived).isNull(), F.col(arrived), F.col(shard).isNull(), F.col(shard), F.col("content")]


def compact(df: DataFrame, path: str, cell: Cell | None = None, rows_per_file: int = 200_000, arrived: str = "ingested_at", fragment: str = "shard") -> DataFrame:
    """Write the cells of ``df``, each once, into few files of even size under ``path``/cells; one row of figures comes back.

    ``path``/copies gets (plate, sample, barcode, shard) for every fragment of each cell that came in more than one, in the same layout.
    Columns of the figures: ``rows_in, copies_left_out, files, rows_out, smallest_file, largest_file, digest_equal``. ``digest_equal`` compares what the source ought to keep,
    rows and copies alike, with what is read back from the files. An empty table gives zeros and true. Rows without a full identity are nobody's copy and all stay."""
    spark = df.sparkSession
    columns = df.columns
    keyed = _keyed(df, cell or Cell.of(), arrived, fragment)
    best = F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_arrival())], F.col("check").alias("check")))
    # keys and hashes only: one row per cell and fragment, combined before the shuffle
    seen = materialize(keyed.filter("whole").groupBy(*IDENTITY, "shard").agg(F.count(F.lit(1)).alias("n"), best.alias("best")), "sightings")
    cells = seen.groupBy(*IDENTITY).agg(F.sum("n").alias("n"), F.count("shard").alias("fragments"), F.min("best").alias("best"))
    cells = materialize(cells.select(*IDENTITY, "n", "fragments", F.col("best.k4").alias("content"), F.col("best.check").alias("check")), "cells-once")
    lone = materialize(keyed.filter("not whole").groupBy("plate", "sample").agg(*row_digest()), "lone-rows")
    plan = layout(cells.select("plate", "sample", F.lit(1).alias("n")).union(lone.select("plate", "sample", F.col("n_rows"))), rows_per_file)

    # a cell with more copies than a file has rows would swell its file: such cells (fewer than files) are reduced first, with a limit before the shuffle
    swollen = F.broadcast(cells.filter(F.col("n") > rows_per_file).select(*IDENTITY))
    rows, preferred = keyed, _arrival(f"row.{arrived}", f"row.{fragment}")
    if cells.filter(F.col("n") > rows_per_file).limit(1).count():
        reduced = keyed.join(swollen, IDENTITY, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(*preferred))).filter("nth = 1").drop("nth")
        rows = keyed.join(swollen, IDENTITY, "left_anti").unionByName(reduced)
    order = ["file", *IDENTITY]
    arranged = plan.place(rows.select("row", *IDENTITY, "content", "whole", "spread")).drop("spread").repartitionById(plan.files, F.col("file"))
    # of the copies of a cell the one that arrived first, then that of the smallest fragment, then by content; rows without a full identity all stay
    once = arranged.withColumn("nth", F.row_number().over(Window.partitionBy(*order).orderBy(*preferred))).filter("nth = 1 or not whole")
    once.sortWithinPartitions(*order).select("row.*").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cells")

    copies = seen.filter("shard is not null").join(cells.filter("fragments > 1").select(*IDENTITY), IDENTITY, "left_semi").select(*IDENTITY, "shard").withColumn("spread", F.xxhash64(*IDENTITY))
    told = materialize(plan.place(copies).drop("spread"), "copies")
    told.repartitionById(plan.files, F.col("file")).sortWithinPartitions(*order, "shard").select(*IDENTITY, "shard").write.mode("overwrite").parquet(f"{path}/copies")

    back = spark.read.schema(df.schema).parquet(f"{path}/cells").select(F.input_file_name().alias("name"), F.xxhash64(*columns).alias("content"), F.hash(*columns).alias("check")).groupBy("name").agg(*row_digest())
    there = back.agg(F.count(F.lit(1)), F.sum("n_rows"), F.sum("digest_a"), F.sum("digest_b"), F.min("n_rows"), F.max("n_rows")).first()
    mine, rest = cells.agg(F.sum("n"), *row_digest()).first(), lone.agg(F.sum("n_rows"), F.sum("digest_a"), F.sum("digest_b")).first()
    zero = lambda v: int(v or 0)
    due = tuple(zero(a) + zero(b) for a, b in zip(mine[1:], rest))
    digest = lambda t: t.select(F.xxhash64(*IDENTITY, "shard").alias("content"), F.hash(*IDENTITY, "shard").alias("check")).agg(*row_digest()).first()
    equal = due == tuple(map(zero, there[1:4])) and digest(told) == digest(written_copies(spark, path, told))
    rows_in = zero(mine[0]) + zero(rest[0])
    return spark.createDataFrame(
        [(rows_in, rows_in - due[0], there[0], zero(there[1]), zero(there[4]), zero(there[5]), equal)],
        "rows_in long, copies_left_out long, files long, rows_out long, smallest_file long, largest_file long, digest_equal boolean",
    )


def written_copies(spark, path: str, like: DataFrame) -> DataFrame:
    """(plate, sample, barcode, shard, name) of the copies that :func:`compact` wrote, ``name`` being the file; ``like`` has the columns' types."""
    return spark.read.schema(like.select(*IDENTITY, "shard").schema).parquet(f"{path}/copies").withColumn("name", F.input_file_name())


def shared_fragments(df: DataFrame, cell: Cell | None = None, fragment: str = "shard", rows_per_file: int = 50_000) -> DataFrame:
    """(``shard_a``, ``shard_b``), a < b: pairs of fragments that hold at least one cell in common.

    The cells are compacted (:func:`compact`), and the pairs are read off the written files: all copies of a cell stand in one of them. Cells with the same set of fragments are
    reduced to one by an order-free fingerprint of the set, so a pair of fragments that shares very many cells costs one pair; a cell in very many fragments is spread
    over several join keys. Nulls: a row without plate, sample, barcode or fragment matches nothing. Raises where the files do not hold what they should."""
    spark = df.sparkSession
    path = scratch_path(spark, "compacted")
    if not compact(df, path, cell, rows_per_file, fragment=fragment).first()["digest_equal"]:
        raise RuntimeError("the compacted files differ from their source")
    key = ["name", *IDENTITY]
    types = df.select(*[F.lit("").alias(c) for c in IDENTITY], F.col(fragment).alias("shard"))
    copies = written_copies(spark, path, types)
    sets = copies.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.hash("shard").cast("bigint")).alias("f1"), F.expr("bit_xor(xxhash64(shard))").alias("f2"), F.min("shard").alias("lo"), F.max("shard").alias("hi")
    )
    two = sets.filter("n = 2").select(F.col("lo").alias("shard_a"), F.col("hi").alias("shard_b"))
    # cells in three or more fragments: one cell stands for all cells with the same set
    leaders = sets.filter("n > 2").groupBy("n", "f1", "f2", "lo", "hi").agg(F.min(F.struct(*key)).alias("leader")).select("leader.*", F.ceil(F.col("n") / 256).alias("ways"))
    members = copies.join(leaders, key).select(*key, "shard", "ways")
    left = members.select(*key, F.col("shard").alias("shard_a"), F.pmod(F.xxhash64("shard"), F.col("ways")).alias("way"))
    right = members.select(*key, F.col("shard").alias("shard_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)).alias("way"))
    more = left.join(right, [*key, "way"]).filter("shard_a < shard_b").select("shard_a", "shard_b")
    return two.union(more).distinct()
