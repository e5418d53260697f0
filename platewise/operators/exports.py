"""Lookup shards, tolerance comparison of delivered figures, and small report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S


def lookup_rows(values: DataFrame, conditions: DataFrame, top: int = 20) -> DataFrame:
    """(drug, cell_line, dose, condition_id, nth, gene_symbol, measured): per condition the ``top`` genes by size of the measured value (ties: symbol), in hundredths as int."""
    order = Window.partitionBy("condition_id").orderBy(F.abs("y").desc(), "gene_symbol")
    picked = values.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)
    named = conditions.select("condition_id", "drug", "cell_line", "dose")
    return picked.join(named, "condition_id").select("drug", "cell_line", "dose", "condition_id", "nth", "gene_symbol", S.hundredths(F.col("y")).alias("measured"))


def lookup_documents(rows: DataFrame) -> DataFrame:
    """One JSON text per drug: {drug, conditions: {id: {cell_line, dose, genes, measured}}}; a drug's conditions are bounded by lines x doses."""
    ordered = F.array_sort(F.collect_list(F.struct("nth", "gene_symbol", "measured")))
    per = rows.groupBy("drug", "condition_id", "cell_line", "dose").agg(ordered.alias("o"))
    entry = F.struct("cell_line", "dose", F.transform("o", lambda s: s["gene_symbol"]).alias("genes"), F.transform("o", lambda s: s["measured"]).alias("measured"))
    packed = per.groupBy("drug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition_id", entry)))).alias("conditions"))
    return packed.select(S.file_slug("drug").alias("shard"), F.to_json(F.struct("drug", "conditions")).alias("document"))


def write_lookup(documents: DataFrame, path: str) -> None:
    """One folder per drug shard, read back by partition pruning."""
    documents.repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)


def compare_with_tolerance(got: DataFrame, want: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Every mismatch of two tables of figures: (keys..., got, want, reason); numbers may differ by ``tolerance``, null equals null, rows missing on a side are mismatches."""
    g, w = got.select(*keys, F.col(value).alias("got"), F.lit(1).alias("in_got")), want.select(*keys, F.col(value).alias("want"), F.lit(1).alias("in_want"))
    both = g.join(w, keys, "full_outer")
    reason = (
        F.when(F.col("in_got").isNull(), "missing")
        .when(F.col("in_want").isNull(), "unexpected")
        .when(F.col("got").isNull() != F.col("want").isNull(), "null")
        .when(F.abs(F.col("got") - F.col("want")) > tolerance, "differs")
    )
    return both.withColumn("reason", reason).filter("reason is not null").select(*keys, "got", "want", "reason")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; one of more than ``most`` rows raises instead of being cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(text(v) for v in r) + " |" for r in rows)]) + "\n"


def write_sorted(df: DataFrame, path: str, *keys: str | Column) -> None:
    """Parquet, globally ordered by ``keys``, zstd level 9; complete once the success marker is there."""
    df.orderBy(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
