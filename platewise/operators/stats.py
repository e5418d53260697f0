"""Summaries of per-condition scores: medians, quantiles, bootstrap intervals, paired differences, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.operators.skew import exact_percentiles, places
from platewise.session import materialize


def score_summary(scores: DataFrame, metric: str, places_: int = 6) -> DataFrame:
    """Per split: estimate (mean over repeats of medians), interquartile range, n_scored, n_nan. Null, NaN and infinite scores count as n_nan.

    Percentiles are exact and come from numbered rows, so no split need fit a task."""
    value = F.when(S.finite(metric), F.col(metric))
    rows = scores.filter(S.finite(metric)).select("split", "repeat", F.col(metric).cast("double").alias("v"))
    per = medians(scores, ["split", "repeat"], metric).groupBy("split").agg(F.round(F.avg("m"), places_).alias("estimate"))
    quartiles = exact_percentiles(places(rows, ["split"], "v"), ["split"], "v", {"q1": 0.25, "q3": 0.75})
    counts = scores.groupBy("split").agg(F.count(value).alias("n_scored"), (F.count(F.lit(1)) - F.count(value)).alias("n_nan"))
    return counts.join(per, "split", "left").join(quartiles, "split", "left").select("split", F.round("q1", places_).alias("iqr_low"), F.round("q3", places_).alias("iqr_high"), "n_scored", "n_nan", "estimate")


def medians(scores: DataFrame, keys: Sequence[str], metric: str, name: str = "m") -> DataFrame:
    """(keys..., ``name``): the exact median of the finite values of every group, null where it has none; groups may be of any size."""
    rows = scores.filter(S.finite(metric)).select(*keys, F.col(metric).cast("double").alias("v"))
    found = exact_percentiles(places(rows, keys, "v"), keys, "v", {name: 0.5})
    every = scores.select(*keys).distinct()
    return every.alias("e").join(found.alias("f"), [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left").select(*[F.col(f"e.{k}") for k in keys], F.col(f"f.{name}"))


def bootstrap_intervals(scores: DataFrame, keys: Sequence[str], metric: str, resamples: int = 2000, interval: float = 0.95, seed: int = 20260927, block: int = 50) -> DataFrame:
    """(keys..., estimate, ci_low, ci_high): interval of the mean over repeats of medians, conditions resampled within their repeat.

    Of a resample only its middle values matter, so their places are drawn: the k-th smallest of n uniform draws is Beta(k, n - k + 1), the next one the smallest of the n - k draws above it. That is the
    distribution of drawing all n, at the same cost for any n. Draws are made in ``block``-sized tasks (group, repeat, block), seeded by the group, so the result does not depend on the
    partitioning; the values stay rows, numbered within their repeat by range partitions."""
    group = [*keys, "repeat"]
    rows = scores.filter(S.finite(metric)).select(*group, F.col(metric).cast("double").alias("v"))
    placed = materialize(places(rows, group, "v"), "bootstrap-places")
    sizes = placed.groupBy(*group).agg(F.max("group_rows").alias("n"))
    tasks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // block))))
    fields = ", ".join(f"{k} {scores.schema[k].dataType.simpleString()}" for k in keys)

    def draw(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                n, first = int(r["n"]), int(r["block"]) * block
                rng = np.random.default_rng([seed, *("|".join(str(r[k]) for k in keys) + f"|{r['repeat']}|{r['block']}").encode()])
                many, k = min(block, resamples - first), (n + 1) // 2
                low = rng.beta(k, n - k + 1, many)
                high = low if n % 2 else 1 - (1 - low) * rng.random(many) ** (1 / (n - k))
                for i, pair in enumerate(zip(*(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high)))):
                    out.extend((*[r[x] for x in keys], int(r["repeat"]), first + i, int(p)) for p in pair)
            yield pd.DataFrame(out, columns=[*group, "draw", "place"])

    drawn = tasks.repartition(*group, "block").mapInPandas(draw, f"{fields}, repeat int, draw int, place long")
    draws = drawn.join(placed, [*group, "place"]).groupBy(*group, "draw").agg(F.avg("v").alias("m")).groupBy(*keys, "draw").agg(F.avg("m").alias("m"))
    alpha = (1 - interval) / 2
    bounds = draws.groupBy(*keys).agg(F.percentile("m", F.lit(alpha)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha)).alias("ci_high"))
    estimate = exact_percentiles(placed, group, "v", {"m": 0.5}).groupBy(*keys).agg(F.avg("m").alias("estimate"))
    return estimate.join(bounds, list(keys))


def paired_differences(scores: DataFrame, model_a: str, model_b: str, metric: str) -> DataFrame:
    """(repeat, split, condition_id, difference) of two models where both have a finite score; a repeated score counts by its smallest value."""
    keys = ["repeat", "split", "condition_id"]
    one = lambda m, n: scores.filter((F.col("model") == m) & S.finite(metric)).groupBy(*keys).agg(F.min(metric).alias(n))
    return one(model_a, "a").join(one(model_b, "b"), keys).select(*keys, (F.col("a") - F.col("b")).alias("difference"))


def with_no_difference(intervals: DataFrame) -> DataFrame:
    """Adds ``no_detectable_difference``: the interval holds 0."""
    return intervals.withColumn("no_detectable_difference", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))


def verdict(de_low: str, disc_estimate: str):
    """SUCCESS where the difference in correlation is above 0 with its whole interval and the rank got smaller."""
    return F.when((F.col(de_low) > 0) & (F.col(disc_estimate) < 0), "SUCCESS").otherwise("FAILURE")


def model_table(summaries: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Model x split table of ``estimate [low, high] coverage`` texts; a missing pair is ``n.d.``. ``summaries`` (model, split, estimate, ci_low, ci_high) may have a ``coverage`` (0 to 1)."""
    text = F.concat(F.format_number("estimate", 4), F.lit(" ["), F.format_number("ci_low", 4), F.lit(", "), F.format_number("ci_high", 4), F.lit("]"))
    if "coverage" in summaries.columns:
        text = F.concat(text, F.lit(" "), F.format_number(F.col("coverage") * 100, 0), F.lit("%"))
    return summaries.withColumn("t", text).groupBy("model").pivot("split", list(splits)).agg(F.first("t")).fillna("n.d.", list(splits))


def summary_documents(scores: DataFrame, metrics: Sequence[str], resamples: int = 2000) -> DataFrame:
    """(model, document): one JSON text per model with, for every metric, a list of {split, estimate, ci_low, ci_high, iqr_low, iqr_high, n_scored, n_nan, repeat_medians}."""
    out = None
    for metric in metrics:
        value = F.when(S.finite(metric), F.col(metric))
        per_repeat = medians(scores, ["model", "split", "repeat"], metric).groupBy("model", "split").agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat", "m"))), lambda r: r["m"]).alias("repeat_medians"))
        counts = scores.groupBy("model", "split").agg(F.count(value).alias("n_scored"), (F.count(F.lit(1)) - F.count(value)).alias("n_nan"))
        rows = scores.filter(S.finite(metric)).select("model", "split", F.col(metric).cast("double").alias("v"))
        quartiles = exact_percentiles(places(rows, ["model", "split"], "v"), ["model", "split"], "v", {"iqr_low": 0.25, "iqr_high": 0.75})
        joined = counts.join(per_repeat, ["model", "split"]).join(quartiles, ["model", "split"], "left").join(bootstrap_intervals(scores, ["model", "split"], metric, resamples), ["model", "split"], "left")
        entry = F.struct("split", F.lit(metric).alias("metric"), "estimate", "ci_low", "ci_high", "iqr_low", "iqr_high", "repeat_medians", "n_scored", "n_nan")
        one = joined.groupBy("model").agg(F.array_sort(F.collect_list(entry)).alias("entries")).withColumn("metric", F.lit(metric))
        out = one if out is None else out.union(one)
    packed = out.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "entries")))).alias("summaries"))
    return packed.select("model", F.to_json(F.struct("model", "summaries")).alias("document"))
