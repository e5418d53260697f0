"""Ridge regression of all genes on condition features, for every repeat and split at once.

Rows of features (one per condition) and targets stay in Spark. Of a fit only sums are needed: features x features per run, and features x gene per run and gene, both Spark aggregates. The
first, as small as the number of features squared, are factorised on the driver; all penalties share the factorisation. Targets are residuals from the mean of the fitted rows at the same dose,
so full shrinkage answers with that mean. The penalty is the one whose answers on the validation rows correlate best with the truth; then the fit is made again on training and validation rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.operators.harness import RUN, _means
from platewise.session import materialize

_RUN_TYPES = "repeat int, split string"


def alpha_grid(start: float = -4.0, stop: float = 6.0, step: float = 0.5) -> list[float]:
    """Powers of ten from ``start`` to ``stop``, both included."""
    return [float(10 ** (start + i * step)) for i in range(int(round((stop - start) / step)) + 1)]


def design(counts: Column, scalars: Sequence[Column], heavy_tailed: Sequence[Column] = ()) -> Column:
    """One feature row: log1p of the fingerprint's counts, log1p of heavy-tailed descriptors, and the other scalars as they are."""
    logs = F.transform(counts, lambda n: F.log1p(n.cast("double")))
    return F.concat(logs, F.array(*[F.log1p(c.cast("double")) for c in heavy_tailed], *[c.cast("double") for c in scalars]))


@dataclass
class Fit:
    """Per run the scaling and the factorised features (held by the driver, features squared), and per run and gene the projected targets, with the means at each dose."""

    solved: dict[tuple, tuple[np.ndarray, ...]]
    weights: DataFrame  # RUN, gene_symbol, q
    at_dose: DataFrame  # RUN, dose, gene_symbol, m


def _moments(rows: DataFrame) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """Per run (rows, sums, sums of products) of ``x``: every task adds up its own rows, entries are summed in Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run, part in pdf.groupby(RUN):
                x = np.stack(part["x"].to_numpy())
                one = np.hstack([np.ones((len(x), 1)), x])
                yield pd.DataFrame({"repeat": run[0], "split": run[1], "g": [(one.T @ one).ravel().tolist()]})

    sums = rows.select(*RUN, "x").mapInPandas(partial, f"{_RUN_TYPES}, g array<double>").select(*RUN, F.posexplode("g").alias("at", "v")).groupBy(*RUN, "at").agg(F.sum("v").alias("v"))
    out = {}
    for run, part in sums.toPandas().groupby(RUN):
        flat = part.sort_values("at")["v"].to_numpy()
        d = int(round(len(flat) ** 0.5))
        m = flat.reshape(d, d)
        out[run] = (int(round(m[0, 0])), m[0, 1:], m[1:, 1:])
    return out


def _solve(n: int, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, ...]:
    """(kept columns, means, deviations, eigenvalues, eigenvectors) of the standardised features; constant columns and empty directions are dropped."""
    mean = total / n
    centred = products - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(centred), 0) / n)
    kept = np.flatnonzero(sd > 1e-9 * np.maximum(1, np.abs(mean)))
    z = centred[np.ix_(kept, kept)] / np.outer(sd[kept], sd[kept])
    values, vectors = np.linalg.eigh(z) if len(kept) else (np.zeros(0), np.zeros((0, 0)))
    there = values > 1e-10 * max(1.0, values.max(initial=0.0))
    return kept, mean[kept], sd[kept], values[there], vectors[:, there]


def fit(rows: DataFrame, targets: DataFrame) -> Fit:
    """``rows`` (RUN, condition_id, dose, x) of the conditions to fit on, ``targets`` (condition_id, gene_symbol, y), a missing one being 0."""
    moments = _moments(rows)
    solved = {run: _solve(*m) for run, m in moments.items()}
    width = len(next(iter(moments.values()))[1]) if moments else 0
    _, at_dose = _means(rows, targets, ["dose"])
    at_dose = materialize(at_dose, "ridge-dose-means")
    # sum of x * (y - mean at the dose): the second part needs the sums of x per dose only
    x = [F.col("x")[j] for j in range(width)]
    own = rows.select(*RUN, "condition_id", "x").join(targets.filter("y <> 0"), "condition_id").select(*RUN, "gene_symbol", "x", F.col("y").cast("double").alias("c"))
    per_dose = rows.groupBy(*RUN, "dose").agg(F.array(*[F.sum(v) for v in x]).alias("x")) if width else rows.select(*RUN, "dose", "x").limit(0)
    taken = at_dose.join(per_dose, [*RUN, "dose"]).select(*RUN, "gene_symbol", "x", (-F.col("m")).alias("c"))
    summed = own.unionByName(taken).groupBy(*RUN, "gene_symbol").agg(F.array(*[F.sum(v * F.col("c")) for v in x]).cast("array<double>").alias("xr"))
    told = rows.sparkSession.sparkContext.broadcast(solved)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run, part in pdf.groupby(RUN):
                kept, _, sd, _, vectors = told.value[run]
                q = (np.stack(part["xr"].to_numpy())[:, kept] / sd) @ vectors
                yield pd.DataFrame({"repeat": run[0], "split": run[1], "gene_symbol": part["gene_symbol"], "q": list(q)})

    return Fit(solved, summed.mapInPandas(project, f"{_RUN_TYPES}, gene_symbol string, q array<double>"), at_dose)


def answer(fitted: Fit, asked: DataFrame, rows: DataFrame, alphas: Sequence[float] | None = None) -> DataFrame:
    """Answers for ``asked`` (RUN, condition_id, gene_symbol and others): the asked columns with ``p``, one number per penalty.

    ``rows`` (RUN, condition_id, dose, x) holds the features; without ``alphas`` its column ``alpha`` names the penalty of the run. A condition without features has no answer."""
    told = asked.sparkSession.sparkContext.broadcast(fitted.solved)
    grid = None if alphas is None else np.asarray(alphas, dtype=float)
    joined = asked.join(rows.withColumnRenamed("x", "x_"), [*RUN, "condition_id"]).join(fitted.weights, [*RUN, "gene_symbol"], "left").join(fitted.at_dose, [*RUN, "dose", "gene_symbol"], "left")
    names = asked.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields], "p array<double>"])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run, part in pdf.groupby(RUN):
                if run not in told.value:
                    continue
                kept, mean, sd, values, vectors = told.value[run]
                u = ((np.stack(part["x_"].to_numpy())[:, kept] - mean) / sd) @ vectors
                # a gene without a row has no training value but 0
                q = np.stack([v if v is not None else np.zeros(len(values)) for v in part["q"]]) if len(values) else np.zeros((len(part), 0))
                by = grid if grid is not None else part["alpha"].to_numpy()[:1]
                p = (u * q) @ (1 / (values[:, None] + by[None, :])) + part["m"].fillna(0.0).to_numpy()[:, None]
                yield part[names].assign(p=list(p.astype(np.float32).astype(float)))

    return joined.mapInPandas(predict, schema)


def validation_scores(answers: DataFrame, values: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(RUN, alpha, val_de_pearson): per penalty the median over validation conditions of the correlation over their DE genes; the model learns no more of these rows than this number."""
    truth = answers.join(values.select("condition_id", "gene_symbol", F.col("y").cast("double").alias("y")), ["condition_id", "gene_symbol"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    per = truth.select(*RUN, "condition_id", "y", F.posexplode("p").alias("at", "v")).groupBy(*RUN, "condition_id", "at").agg(F.when(F.count(F.lit(1)) > 1, S.pearson(F.col("v"), F.col("y"))).alias("r"))
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    return per.groupBy(*RUN, "at").agg(F.median("r").alias("val_de_pearson")).select(*RUN, F.element_at(grid, F.col("at") + 1).alias("alpha"), "val_de_pearson")


def best_penalties(scored: DataFrame) -> DataFrame:
    """(RUN, alpha, val_de_pearson): the largest score, a missing one last; of equal ones the larger penalty."""
    best = F.max(F.struct(F.round(F.coalesce("val_de_pearson", F.lit(-2.0)), 12).alias("s"), "alpha", "val_de_pearson"))
    return scored.groupBy(*RUN).agg(best.alias("b")).select(*RUN, "b.alpha", "b.val_de_pearson")


def train(runs: DataFrame, features: DataFrame, targets: DataFrame, sets: DataFrame, alphas: Sequence[float] | None = None) -> tuple[Fit, DataFrame]:
    """The refitted model and the chosen penalties (RUN, alpha, val_de_pearson).

    ``runs`` (RUN, condition_id, dose, part), ``features`` (condition_id, x), ``sets`` (condition_id, gene_symbol): DE genes, over which validation is scored. Conditions without features take no part.
    A run without validation rows or DE genes has no penalty and gives no answers."""
    alphas = sorted(alphas or alpha_grid())
    rows = materialize(runs.filter("part <> 'test'").join(features, "condition_id").select(*RUN, "condition_id", "dose", "part", "x"), "ridge-rows")
    first = fit(rows.filter("part = 'train'"), targets)
    val = rows.filter("part = 'val'").select(*RUN, "condition_id", "dose", "x")
    asked = val.select(*RUN, "condition_id").join(sets.select("condition_id", "gene_symbol"), "condition_id")
    chosen = materialize(best_penalties(validation_scores(answer(first, asked, val, alphas), targets, alphas)), "ridge-penalties")
    return fit(rows, targets), chosen


def predict(fitted: Fit, chosen: DataFrame, asked: DataFrame, runs: DataFrame, features: DataFrame) -> DataFrame:
    """(RUN, condition_id, gene_symbol, predicted) for ``asked`` (RUN, condition_id, gene_symbol) of test conditions."""
    rows = runs.filter("part = 'test'").join(features, "condition_id").join(chosen.select(*RUN, "alpha"), RUN).select(*RUN, "condition_id", "dose", "x", "alpha")
    return answer(fitted, asked, rows).select(*RUN, "condition_id", "gene_symbol", F.col("p")[0].cast("float").alias("predicted"))
