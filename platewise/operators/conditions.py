"""Conditions (cell line, drug, dose, plate) from well metadata, and their controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.functions.text import lower_key, plate_key, upper_key
from platewise.operators.contracts import ContractError

WELL = ["sample", "plate", "cell_line"]


def clean_wells(wells: DataFrame) -> DataFrame:
    """Wells with even spelling, repeated rows once. A well without cell line or treatment text names no condition and is left out."""
    return wells.select(
        lower_key("sample").alias("sample"), plate_key("plate").alias("plate"), upper_key("cell_line").alias("cell_line"), lower_key("drug").alias("drug"), "drugname_drugconc", "n_cells"
    ).filter("cell_line is not null and drugname_drugconc is not null").distinct()


def parsed_wells(wells: DataFrame) -> DataFrame:
    """Adds drug_name, dose, unit, is_control and condition_id. The id uses the name as parsed."""
    t = F.col("drugname_drugconc")
    named = wells.withColumns({"drug_name": S.drug_of(t), "dose": S.dose_of(t), "unit": S.unit_of(t)})
    return named.withColumns({"is_control": S.is_control("drug_name"), "condition_id": S.condition_id("cell_line", "drug_name", S.number_text("dose"), "plate")})


def condition_table(wells: DataFrame, lines: Sequence[str] | None = None) -> DataFrame:
    """One row per condition; replicate wells are added up (null keys are groups of their own). ``lines`` restricts the cell lines."""
    rows = parsed_wells(clean_wells(wells))
    if lines is not None:
        rows = rows.filter(F.col("cell_line").isin(list(lines)))
    return rows.groupBy("condition_id", "cell_line", "drug", "drug_name", "dose", "unit", "is_control", "plate").agg(F.sum("n_cells").cast("bigint").alias("n_cells_atlas"))


def condition_lookup(wells: DataFrame) -> DataFrame:
    """(sample, plate, cell_line) -> condition_id; a well that is listed with two treatments takes the smaller id."""
    return parsed_wells(clean_wells(wells)).groupBy(*WELL).agg(F.min("condition_id").alias("condition_id"))


def duplicate_controls(conditions: DataFrame) -> DataFrame:
    """Controls that share cell line and plate with another control."""
    per = Window.partitionBy("cell_line", "plate")
    return conditions.filter("is_control").withColumn("n_controls", F.count(F.lit(1)).over(per)).filter("n_controls > 1")


def assign_controls(conditions: DataFrame, check: bool = True) -> DataFrame:
    """Adds ``control_condition_id``: the control of the same cell line and plate (a control is its own), null where there is none.

    More than one control for a line and plate raises."""
    if check and duplicate_controls(conditions).limit(1).count():
        raise ContractError("more than one control condition for a cell line and plate")
    controls = conditions.filter("is_control").select("cell_line", "plate", F.col("condition_id").alias("control_condition_id"))
    return conditions.join(controls, ["cell_line", "plate"], "left")
