"""Data contracts. Each is one aggregation over the table; a violation raises :class:`ContractError`."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import tidy


class ContractError(ValueError):
    """A table does not keep its contract."""


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``n_rows`` and per column ``nulls_<c>``, for numbers also ``nans_<c>`` and ``infs_<c>``; one pass."""
    picked = columns or df.columns
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    out: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for c in picked:
        out.append(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))
        if c in floats:
            out.append(F.count_if(F.isnan(c)).alias(f"nans_{c}"))
            out.append(F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"infs_{c}"))
    return df.agg(*out)


def check_schema(df: DataFrame, schema: T.StructType, name: str) -> None:
    """Exact columns and types, and no nulls."""
    got, want = [(f.name, f.dataType.simpleString()) for f in df.schema.fields], [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if got != want:
        raise ContractError(f"{name}: columns {got} are not {want}")
    nulls = {k: v for k, v in null_profile(df).first().asDict().items() if k.startswith("nulls_") and v}
    if nulls:
        raise ContractError(f"{name}: {nulls}")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def require_empty(df: DataFrame, message: str) -> None:
    some = df.limit(3).collect()
    if some:
        raise ContractError(f"{message}: {[r.asDict() for r in some]}")


def require_unique(df: DataFrame, keys: Sequence[str], name: str) -> None:
    require_empty(duplicate_groups(df, keys), f"{name}: {list(keys)} is not unique")


def require_known(df: DataFrame, other: DataFrame, keys: Sequence[str], message: str) -> None:
    """Every key of ``df`` occurs in ``other``."""
    require_empty(df.select(*keys).join(other.select(*keys), list(keys), "left_anti"), message)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, int]:
    """How many rows break each rule (true = broken); one pass."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]).first()
    return {n: row[n] for n in rules if row[n]}


def report(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """(table_name, rule, n_rows, n_broken): how many rows break each rule, as a result instead of an error; one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_broken")) for i, n in enumerate(rules)])
    return counted.select(F.lit(table).alias("table_name"), "n_rows", F.inline(entries)).select("table_name", "rule", "n_rows", "n_broken")


def _raise(name: str, broken: dict[str, int]) -> None:
    if broken:
        raise ContractError(f"{name}: {broken}")


def check_conditions(conditions: DataFrame, declared_without_external_id: Sequence[str] = ()) -> None:
    """Required columns, unique ids, an external id or a declared gap, no negative cell numbers, and a control for every treated condition."""
    required = {"condition_id", "cell_line", "drug_name", "dose", "is_control", "plate", "n_cells", "depmap_id", "qc_pass", "control_condition_id"}
    if missing := required - set(conditions.columns):
        raise ContractError(f"conditions: missing columns {sorted(missing)}")
    require_unique(conditions, ["condition_id"], "conditions")
    declared = list(declared_without_external_id)
    rules = {
        "null_key": F.col("condition_id").isNull() | F.col("cell_line").isNull() | F.col("plate").isNull(),
        "external_id": F.col("depmap_id").isNull() & (~F.col("cell_line").isin(declared) if declared else F.lit(True)),
        "negative_cells": F.col("n_cells") < 0,
        "without_control": ~F.col("is_control") & F.col("control_condition_id").isNull(),
    }
    _raise("conditions", violations(conditions, rules))


def check_pseudobulk(pseudobulk: DataFrame, conditions: DataFrame, markers: Sequence[int] = (1,)) -> None:
    """No negative sums, no marker, no repeated (condition, gene), known conditions, one cell number per condition that equals the table's."""
    _raise("pseudobulk", violations(pseudobulk, {"negative": F.col("sum_counts") < 0, "marker": F.col("gene").isin(list(markers))}))
    require_unique(pseudobulk, ["condition_id", "gene"], "pseudobulk")
    require_known(pseudobulk, conditions, ["condition_id"], "pseudobulk: unknown condition")
    per = pseudobulk.groupBy("condition_id").agg(F.min("n_cells").alias("lo"), F.max("n_cells").alias("hi"))
    require_empty(per.join(conditions.select("condition_id", "n_cells"), "condition_id").filter("lo <> hi or lo <> n_cells"), "pseudobulk: cell numbers differ")


def check_log_fold_changes(logfc: DataFrame, schema: T.StructType) -> int:
    """Declared schema; returns the number of conditions."""
    check_schema(logfc, schema, "logfc")
    return logfc.select(F.countDistinct("condition_id")).first()[0]


def check_gene_coverage(pseudobulk: DataFrame, genes: DataFrame) -> None:
    require_known(pseudobulk, genes, ["gene"], "genes without a dictionary entry")


def check_feature_gaps(view: DataFrame, features: Sequence[str]) -> None:
    """Feature columns may be null, NaN or infinite only where a gap is stated."""
    bad = {c: F.col("feature_gap").isNull() & (F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in features}
    _raise("condition features", violations(view, bad))
    _raise("condition features", violations(view, {"flag": F.col("features_complete") != F.col("feature_gap").isNull()}))


def check_splits(assigned: DataFrame, units: DataFrame, unit: str, forbidden_test: DataFrame | None = None) -> None:
    """No repeated record within (repeat, split), no unit with rows on the test side and another, no forbidden line under test."""
    require_unique(assigned, ["repeat", "split", "condition_id"], "splits")
    both = assigned.join(units, "condition_id").filter(F.col(unit).isNotNull())
    require_empty(
        both.groupBy("repeat", "split", unit).agg(F.countDistinct("part").alias("parts")).filter("parts > 1"), f"splits: a {unit} stands in more than one part"
    )
    if forbidden_test is not None:
        require_empty(both.filter("part = 'test'").join(forbidden_test, "cell_line", "left_semi").select("condition_id"), "splits: a forbidden line is tested")


def check_named_splits(assigned: DataFrame, units: DataFrame, demands: Mapping[str, Sequence[str]]) -> None:
    """:func:`check_splits` for all splits in one pass: no repeated record, and no unit in two parts of a split that ``demands`` it whole (split -> columns of ``units``, which has condition_id)."""
    require_unique(assigned, ["repeat", "split", "condition_id"], "splits")
    pairs = [(split, unit) for split, names in demands.items() for unit in names]
    kinds = F.array(*[F.struct(F.lit(unit).alias("kind"), F.when(F.col("split") == split, F.col(unit).cast("string")).alias("unit")) for split, unit in pairs])
    rows = assigned.join(units, "condition_id").select("repeat", "split", "part", F.inline(kinds)).filter("unit is not null")
    torn = rows.groupBy("repeat", "split", "kind", "unit").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    require_empty(torn, "splits: a unit stands in more than one part")


def check_de_sets(de_sets: DataFrame, scoring: DataFrame, least: int) -> None:
    require_known(de_sets, scoring, ["condition_id"], "DE sets outside the scoring set")
    require_empty(de_sets.groupBy("condition_id").count().filter(F.col("count") < least), f"DE sets with fewer than {least} genes")


def check_predictions(predicted: DataFrame, truth: DataFrame) -> None:
    """The same (condition, gene) pairs as the truth, all finite."""
    keys = ["condition_id", "gene_symbol"]
    require_known(truth, predicted, keys, "predictions are missing")
    require_known(predicted, truth, keys, "predictions without a target")
    _raise("predictions", violations(predicted, {"not_finite": F.col("predicted").isNull() | F.isnan("predicted") | (F.abs("predicted") == float("inf"))}))


def check_model_info(info: Mapping[str, object]) -> None:
    """JSON-ready values and a fallback rate within [0, 1]."""
    import json

    try:
        json.dumps(info)
    except TypeError as e:
        raise ContractError(f"model info: {e}") from e
    rate = info.get("fallback_rate", 0.0)
    if not 0 <= float(rate) <= 1:
        raise ContractError(f"model info: fallback_rate {rate}")


def check_targets(targets: DataFrame, conditions: DataFrame, genes: DataFrame) -> None:
    """As many targets as conditions times genes, with unique ids on both sides."""
    require_unique(conditions, ["condition_id"], "target conditions")
    require_unique(genes, ["gene_symbol"], "target genes")
    n, want = targets.count(), conditions.count() * genes.count()
    if n != want:
        raise ContractError(f"targets: {n} values, {want} expected")


def check_output_size(spark, path: str, limit_bytes: int | None) -> int:
    """Bytes under ``path`` by the file system's own listing; above ``limit_bytes`` raises, None only reports."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()
    if limit_bytes is not None and size > limit_bytes:
        raise ContractError(f"{path} holds {size} bytes; the limit is {limit_bytes}")
    return size


def write_checked(df: DataFrame, path: str, check: Callable[[DataFrame], None]) -> DataFrame:
    """Write ``df`` as Parquet, hold what was written against its contract, and give it back; a broken contract takes the files away again and raises."""
    spark = df.sparkSession
    with tidy(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    try:
        with tidy(spark):
            check(written)
    except ContractError:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        raise
    return written
