"""Incremental ingest of cell fragments: each micro-batch appends partial sums, the profiles come from merging all partials."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from platewise.operators.conditions import WELL
from platewise.operators.pseudobulk import clean_cells, spread, totals


def _source_path(spark: SparkSession, path: str) -> str:
    """The file source wants a folder or a pattern: a single file becomes a pattern that only it matches."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(jvm_path) and fs.getFileStatus(jvm_path).isFile() else path


def choice_key(lines: Sequence[str]) -> str:
    """A name for a choice of cell lines, whatever their order and spelling."""
    return "c" + hashlib.sha1(",".join(sorted({x.strip().upper() for x in lines})).encode()).hexdigest()[:12]


def slice_key(plate: Column, choice: str) -> Column:
    """The key of a partial: its plate and the choice of lines. Another plate, or another choice, has another key and touches no partial that is there."""
    return F.concat(F.lit("s"), F.substring(F.sha1(F.concat(F.coalesce(plate, F.lit("")), F.lit("|" + choice))), 1, 12))


def ingest(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, files_per_batch: int = 100, clean: bool = False, lines: Sequence[str] = ()) -> StreamingQuery:
    """Read every file of ``folder`` (or one file) that was not read before and append partial totals below ``out``; ends when nothing is left.

    A batch is reduced in one pass and writes into folders ``choice=<lines>/batch=<id>/slice=<plate and lines>`` (``lines``: all where none are named): a batch that is repeated after
    a failure replaces its own and counts once, and a fragment that holds cells of several plates is reduced once into a partial of each. ``clean`` lets the source delete files of
    finished batches. A restart on the same checkpoint adds nothing. Figures of each batch are kept in ``out``/log."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if clean:
        source = source.option("cleanSource", "delete")
    wanted, choice = [x.strip().upper() for x in lines], choice_key(lines)

    def reduce_batch(batch: DataFrame, number: int) -> None:
        cells = clean_cells(spread(batch))
        if wanted:
            cells = cells.filter(F.col("cell_line").isin(wanted))
        began = time.time()
        keyed = totals(cells, WELL).withColumn("slice", slice_key(F.col("plate"), choice))
        path = f"{out}/partials/choice={choice}/batch={number}"
        keyed.write.mode("overwrite").partitionBy("slice").parquet(path)
        written = spark.read.schema(keyed.schema).parquet(path)
        figures = written.agg(F.count(F.lit(1)).alias("partial_rows"), F.sum(F.when(F.col("gene").isNull(), F.col("total"))).cast("bigint").alias("cells_kept"))
        figures.select(F.lit(number).cast("bigint").alias("batch"), "partial_rows", "cells_kept", F.lit(round(time.time() - began, 3)).alias("seconds")).write.mode("overwrite").parquet(f"{out}/log/choice={choice}/batch={number}")

    return source.parquet(_source_path(spark, folder)).writeStream.foreachBatch(reduce_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partials(spark: SparkSession, out: str, plates: Sequence[str] | None = None, lines: Sequence[str] = ()) -> DataFrame:
    """All partial totals so far of a choice of ``lines``; with ``plates`` only their folders are read."""
    choice = choice_key(lines)
    stored = spark.read.parquet(f"{out}/partials").filter(F.col("choice") == choice)
    if plates is not None:
        keys = [r[0] for r in spark.createDataFrame([(p,) for p in plates], "p string").select(slice_key(F.col("p"), choice)).collect()]
        stored = stored.filter(F.col("slice").isin(keys))
    return stored.select(*WELL, "gene", "total")


def log(spark: SparkSession, out: str) -> DataFrame:
    """(choice, batch, partial_rows, cells_kept, seconds) of every finished batch."""
    return spark.read.parquet(f"{out}/log").select("choice", "batch", "partial_rows", "cells_kept", "seconds")


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and seconds per finished batch of a running or ended query."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000} for p in query.recentProgress]
