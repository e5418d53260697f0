"""Quality flags, the per-line summary, and what was dropped and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def qc_flags(conditions: DataFrame, min_cells: int, min_control_cells: int) -> DataFrame:
    """Adds ``qc_pass``: enough processed cells; controls need more."""
    return conditions.withColumn("qc_pass", F.col("n_cells") >= F.when(F.col("is_control"), F.lit(min_control_cells)).otherwise(F.lit(min_cells)))


def with_processed_cells(conditions: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Adds the processed ``n_cells`` (0 where none were seen)."""
    return conditions.join(n_cells, "condition_id", "left").fillna({"n_cells": 0})


def per_line(conditions: DataFrame, libraries: DataFrame) -> DataFrame:
    """Per cell line: conditions, kept ones, median cells, median library of kept conditions."""
    joined = conditions.join(libraries, "condition_id", "left")
    return joined.groupBy("cell_line").agg(
        F.count(F.lit(1)).alias("n_conditions"),
        F.sum(F.col("qc_pass").cast("int")).cast("long").alias("n_kept"),
        F.median("n_cells").alias("median_cells"),
        F.median(F.when(F.col("qc_pass"), F.col("library_size"))).alias("median_library"),
    )


def dropped(conditions: DataFrame, min_cells: int, min_control_cells: int) -> DataFrame:
    """(condition_id, reason) of conditions that fail."""
    need = F.when(F.col("is_control"), F.lit(min_control_cells)).otherwise(F.lit(min_cells))
    kind = F.when(F.col("is_control"), F.lit("control")).otherwise(F.lit("treated"))
    return conditions.filter(~F.col("qc_pass")).select("condition_id", F.format_string("%s condition with %d cells, %d needed", kind, F.col("n_cells").cast("long"), need.cast("long")).alias("reason"))


def summary(conditions: DataFrame) -> DataFrame:
    """One row: totals, kept, controls, controls kept, conditions without control, mean cells of kept conditions (0 if none), status."""
    kept = F.col("qc_pass")
    out = conditions.agg(
        F.count(F.lit(1)).alias("n_conditions"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(F.col("is_control")).alias("n_controls"),
        F.count_if(F.col("is_control") & kept).alias("n_controls_kept"),
        F.count_if(~F.col("is_control") & F.col("control_condition_id").isNull()).alias("n_without_control"),
        F.coalesce(F.round(F.avg(F.when(kept, F.col("n_cells"))), 6), F.lit(0.0)).alias("mean_kept_cells"),
    )
    status = F.when(F.col("n_kept") == 0, "empty").when((F.col("n_controls_kept") < F.col("n_controls")) | (F.col("n_without_control") > 0), "warnings").otherwise("ok")
    return out.withColumn("status", status)


def controls(conditions: DataFrame) -> DataFrame:
    return conditions.filter("is_control").select("cell_line", "plate", F.col("condition_id").alias("control_condition_id"), "n_cells", "qc_pass")
