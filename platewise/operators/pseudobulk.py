"""Sparse cells to per-condition gene sums, library sizes, counts per million and log fold-changes, each as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.functions.text import lower_key, plate_key, upper_key
from platewise.operators.conditions import WELL
from platewise.session import materialize

#: Marker entries at the head of every cell; not genes.
MARKERS = (1,)


def spread(cells: DataFrame) -> DataFrame:
    """A table of few, large splits over all cores before its arrays are unfolded; one with enough splits is left as it is (no shuffle at scale)."""
    cores = cells.sparkSession.sparkContext.defaultParallelism
    return cells.repartition(cores) if cells.rdd.getNumPartitions() < cores else cells


def clean_cells(cells: DataFrame) -> DataFrame:
    """Cells with even spelling of their well; only what later steps read."""
    return cells.select(lower_key("sample").alias("sample"), plate_key("plate").alias("plate"), upper_key("cell_line").alias("cell_line"), "genes", "expressions")


def cells_per_well(cells: DataFrame) -> DataFrame:
    """Number of cells per (sample, plate, cell_line), counted before any unfolding; null keys are groups."""
    return cells.groupBy(*WELL).agg(F.count(F.lit(1)).alias("n_cells"))


def _pairs(cells: DataFrame, keys: Sequence[str], markers: Sequence[int]) -> DataFrame:
    """``keys`` with (gene, amount) of every entry: parallel arrays unfolded together (the shorter padded with nulls), markers and incomplete pairs dropped."""
    pairs = cells.select(*keys, F.inline(F.arrays_zip(F.col("genes").alias("gene"), F.col("expressions").alias("amount"))))
    return pairs.filter(F.col("gene").isNotNull() & F.col("amount").isNotNull() & ~F.col("gene").isin(list(markers)))


def sums_per_well(cells: DataFrame, markers: Sequence[int] = MARKERS) -> DataFrame:
    """(sample, plate, cell_line, gene, total), in double."""
    return _pairs(cells, WELL, markers).groupBy(*WELL, "gene").agg(F.sum(F.col("amount").cast("double")).alias("total"))


def totals(cells: DataFrame, keys: Sequence[str], markers: Sequence[int] = MARKERS) -> DataFrame:
    """(keys..., gene, total) in one pass: the sums per gene, and the number of cells as the row without a gene.

    Every cell brings one entry of its own beside those of its arrays, so sums and counts come out of one scan and one map-side combined shuffle."""
    zipped = F.arrays_zip(F.col("genes").alias("gene"), F.col("expressions").alias("amount"))
    kept = F.filter(zipped, lambda e: e["gene"].isNotNull() & e["amount"].isNotNull() & ~e["gene"].isin(list(markers)))
    entry = F.struct(F.lit(None).cast("bigint").alias("gene"), F.lit(1.0).cast("float").alias("amount"))
    entries = F.concat(F.array(entry), F.coalesce(kept, F.array().cast("array<struct<gene:bigint,amount:float>>")))
    return cells.select(*keys, F.inline(entries)).groupBy(*keys, "gene").agg(F.sum(F.col("amount").cast("double")).alias("total"))


def profiles(summed: DataFrame) -> DataFrame:
    """(condition_id, gene, sum_counts, n_cells, library_size) from stored :func:`totals` per condition; a fractional sum raises.

    Numbers of cells and library sizes form one small table per condition, which meets the long rows without shuffling them again where it fits a broadcast."""
    what = F.concat_ws(" ", "condition_id", F.col("gene").cast("string"))
    counted = summed.filter("gene is not null").select("condition_id", F.col("gene").cast("int").alias("gene"), S.whole_number(F.col("total"), what).alias("sum_counts"))
    sizes = summed.groupBy("condition_id").agg(F.sum(F.when(F.col("gene").isNull(), F.col("total"))).cast("int").alias("n_cells"), F.sum(F.when(F.col("gene").isNotNull(), F.col("total"))).cast("bigint").alias("library_size"))
    return counted.join(sizes, "condition_id").select("condition_id", "gene", "sum_counts", "n_cells", "library_size")


def condition_totals(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """:func:`totals` per condition, written once: profiles, cell numbers and library sizes are read off it.

    The lookup (one row per well) meets the cells before their arrays are unfolded, so unlisted cells never are. Cells of unlisted wells, or without a full well key, belong to no condition."""
    return materialize(totals(cells.join(lookup, WELL), ["condition_id"]), "condition-totals")


def cell_numbers(summed: DataFrame) -> DataFrame:
    """(condition_id, n_cells) from stored :func:`totals` per condition."""
    return summed.filter("gene is null").select("condition_id", F.col("total").cast("int").alias("n_cells"))


def pseudobulk(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """(condition_id, gene, sum_counts, n_cells, library_size); an empty table gives no rows."""
    return profiles(condition_totals(cells, lookup))


def merge_partials(partials: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same from stored :func:`totals` per well of separate ingests; sums commute, so any order and number of partials will do, and they are added up once."""
    summed = partials.join(lookup, WELL).groupBy("condition_id", "gene").agg(F.sum("total").alias("total"))
    return profiles(materialize(summed, "condition-totals"))


def cpm(bulk: DataFrame) -> DataFrame:
    return bulk.select("condition_id", "gene", S.counts_per_million("sum_counts", "library_size").alias("cpm"))


def log_fold_changes(bulk: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition_id, control_condition_id, gene, logfc) for quality-passing treated conditions with a quality-passing control, genes seen on either side.

    ``conditions`` needs condition_id, is_control, qc_pass, control_condition_id. The profiles are reduced to the wanted conditions before the
    control fans out; the two sides meet in one full outer join on (condition, gene)."""
    good = conditions.filter("qc_pass").select("condition_id")
    pairs = (
        conditions.filter("qc_pass and not is_control and control_condition_id is not null")
        .select("condition_id", "control_condition_id")
        .join(good.withColumnRenamed("condition_id", "control_condition_id"), "control_condition_id", "left_semi")
    )
    values = cpm(bulk)
    treated = values.join(pairs.select("condition_id"), "condition_id", "left_semi").withColumnRenamed("cpm", "treated")
    control = (
        pairs.join(values.withColumnRenamed("condition_id", "control_condition_id"), "control_condition_id").select("condition_id", "gene", F.col("cpm").alias("control"))
    )
    both = treated.join(control, ["condition_id", "gene"], "full_outer")
    return both.join(pairs, "condition_id").select("condition_id", "control_condition_id", "gene", S.log_fold_change(F.col("treated"), F.col("control")).cast("float").alias("logfc"))


def zero_genes(bulk: DataFrame, vocabulary: DataFrame, first: int = 20) -> DataFrame:
    """One row: how many vocabulary genes no condition shows, and the first ones in order."""
    unseen = vocabulary.select("gene").distinct().join(bulk.select("gene").distinct(), "gene", "left_anti")
    head = ",".join(str(r["gene"]) for r in unseen.orderBy("gene").limit(first).collect())
    return unseen.agg(F.count(F.lit(1)).alias("n_zero_genes")).withColumn("first_genes", F.lit(head or None).cast("string"))
