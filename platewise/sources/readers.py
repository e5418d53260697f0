"""Readers: file lists and partitioned folders, shard pruning, metadata with a CSV fallback, wide panels, summary documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import materialize


def read_shards(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """One frame over an explicit list of files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def read_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """A hive-partitioned folder; filters on its keys prune folders."""
    return spark.read.parquet(folder)


def prune_shards(index: DataFrame, plates: DataFrame) -> DataFrame:
    """Shards of ``index`` (shard, plate_min, plate_max) whose range holds one of ``plates`` (plate). Bounds compare as strings, so the answer may be too wide, never too narrow.

    Plates are met by the range of their text; Spark broadcasts the smaller side by its size."""
    wanted = plates.select("plate").filter("plate is not null").distinct()
    return index.join(wanted, (F.col("plate_min") <= F.col("plate")) & (F.col("plate_max") >= F.col("plate")), "left_semi").select("shard").distinct()


def read_metadata(spark: SparkSession, parquet: str | None, csv: str | None, keys: Sequence[str], keep: str = "full") -> DataFrame:
    """Per-cell metadata reduced to counts per ``keys``; Parquet where given, else CSV with a header. A ``pass_filter`` column is applied where there is one.

    The counts are written once into the shared folder, so later steps read them instead of the cells; a CSV is read as text, its columns typed by use."""
    cells = spark.read.parquet(parquet) if parquet else spark.read.option("header", True).csv(csv)
    if "pass_filter" in cells.columns:
        cells = cells.filter(F.col("pass_filter") == keep)
    return materialize(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")), "metadata")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A wide matrix (first column the row's id, then one column per ``SYMBOL (number)``) as long rows (row_id, gene, value)."""
    wide = spark.read.option("header", True).option("maxColumns", 65536).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return melt_panel(wide)


def melt_panel(wide: DataFrame) -> DataFrame:
    first, *rest = wide.columns
    cast = wide.select(F.col(f"`{first}`").alias("row_id"), *[F.col(f"`{c}`").cast("float").alias(c) for c in rest])
    return cast.unpivot("row_id", [F.col(f"`{c}`") for c in rest], "gene", "value").withColumn("gene", F.element_at(F.split("gene", r" \("), 1)).filter("value is not null")


def panel_symbols(columns: Sequence[str]) -> list[str]:
    """Symbols of a panel's columns from its schema alone."""
    return [c.rsplit(" (", 1)[0] for c in columns]


SUMMARY = (
    "model string, summaries map<string, array<struct<split:string, metric:string, estimate:double, ci_low:double, ci_high:double, iqr_low:double, iqr_high:double, "
    "repeat_medians:array<double>, n_scored:bigint, n_nan:bigint>>>"
)


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary documents (one JSON per model, any layout below ``pattern``) as rows (source_file, model, metric, split, estimate, ...)."""
    docs = spark.read.schema(SUMMARY).option("multiLine", True).json(pattern).withColumn("source_file", F.input_file_name())
    flat = docs.select("source_file", "model", F.explode("summaries").alias("metric", "entries"))
    return flat.select("source_file", "model", "metric", F.explode("entries").alias("e")).select("source_file", "model", "metric", "e.split", "e.estimate", "e.ci_low", "e.ci_high", "e.iqr_low", "e.iqr_high", "e.repeat_medians", "e.n_scored", "e.n_nan")
