"""Own changes against an external differential-expression table, all conditions in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.operators.contracts import ContractError


def sample_conditions(pool: DataFrame, n: int, seed: str) -> DataFrame:
    """At most ``n`` ids of ``pool``, in the order of md5(seed | id): seeded, repeatable, without replacement."""
    return pool.select("condition_id").filter("condition_id is not null").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), "condition_id")), "condition_id").limit(n)


def name_match(names: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(``name``, matched): the equal known name, else the smallest one equal but for blanks around it, else null."""
    k = known.select(F.col(name).alias("k")).filter("k is not null").distinct()
    exact = names.join(k, F.col(name) == F.col("k"), "left").withColumnRenamed("k", "exact")
    loose = k.groupBy(F.trim("k").alias("t")).agg(F.min("k").alias("loose"))
    return exact.join(loose, F.trim(F.col(name)) == F.col("t"), "left").select(name, F.coalesce("exact", "loose").alias("matched"))


def match_slices(own: DataFrame, theirs: DataFrame, at: Sequence[str] = ("cell_line", "plate", "drug"), relative: float = 1e-6) -> DataFrame:
    """(condition_id, other_id, n_matches): the slice of ``theirs`` (other_id, ``at``, dose, unit) that each condition of ``own`` (condition_id, ``at``, dose, unit) stands for.

    Doses are compared in micromolar, within ``relative``; an unknown unit raises. A condition without a match, or with more than one, is listed without ``other_id`` and with their number, never
    dropped. Null keys and doses match nothing."""
    o = own.select("condition_id", *at, S.to_micromolar("dose", "unit").alias("own_dose"))
    t = theirs.select("other_id", *at, S.to_micromolar("dose", "unit").alias("their_dose")).distinct()
    # equal keys bring few doses together; the tolerance is tried among those
    close = o.join(t, list(at)).filter(S.close_to(F.col("own_dose"), F.col("their_dose"), relative))
    found = close.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.min("other_id").alias("other"))
    joined = own.select("condition_id").distinct().join(found, "condition_id", "left")
    return joined.select("condition_id", F.when(F.col("n") == 1, F.col("other")).alias("other_id"), F.coalesce("n", F.lit(0)).alias("n_matches"))


def check_one_row_per_gene(theirs: DataFrame) -> None:
    """Raises where a condition of ``theirs`` (condition_id, gene_symbol) has two rows of one gene, which would mix two measurements."""
    twice = theirs.groupBy("condition_id", "gene_symbol").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ContractError(f"more than one row per gene: {[(r['condition_id'], r['gene_symbol']) for r in twice]}")


def own_changes(logfc: DataFrame, dictionary: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition_id, gene_symbol, logfc): the own fold-changes of ``conditions``, genes named by the ``dictionary`` (gene, gene_symbol)."""
    wanted = logfc.join(conditions.select("condition_id"), "condition_id", "left_semi")
    return wanted.join(dictionary.select("gene", "gene_symbol"), "gene").select("condition_id", "gene_symbol", "logfc")


def compare(ours: DataFrame, theirs: DataFrame, below: float = 0.05, places: int = 9) -> DataFrame:
    """Per condition of ``theirs`` (condition_id, gene_symbol, log2foldchange, padj) against ``ours`` (condition_id, gene_symbol, logfc): n_compared, n_ambiguous, sign_agreement, spearman.

    Rows with a null or NaN number are dropped; symbols that occur twice for a condition on either side are ambiguous, dropped and counted; only padj strictly
    ``below`` counts. Spearman is Pearson's r of average ranks, null with fewer than two different values on a side; nothing to compare gives nulls."""
    good = theirs.filter(S.finite("padj") & S.finite("log2foldchange") & (F.col("padj") < below) & F.col("condition_id").isNotNull() & F.col("gene_symbol").isNotNull())
    keys = ["condition_id", "gene_symbol"]
    per = Window.partitionBy(*keys)
    t = good.withColumn("nt", F.count(F.lit(1)).over(per))
    o = ours.filter(S.finite("logfc") & F.col("gene_symbol").isNotNull()).withColumn("no", F.count(F.lit(1)).over(per))
    both = t.select(*keys, "log2foldchange", "nt").join(o.select(*keys, "logfc", "no"), keys)
    clear = both.filter("nt = 1 and no = 1")
    ranked = clear.withColumn("rx", S.average_rank("logfc", ["condition_id"])).withColumn("ry", S.average_rank("log2foldchange", ["condition_id"]))
    scored = ranked.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.round(F.avg((F.signum("logfc") == F.signum("log2foldchange")).cast("double")), places).alias("sign_agreement"),
        F.round(F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), S.pearson(F.col("rx"), F.col("ry"))), places).alias("spearman"),
    )
    ambiguous = t.groupBy("condition_id").agg(F.countDistinct(F.when(F.col("nt") > 1, F.col("gene_symbol"))).alias("n_ambiguous"))
    return ambiguous.join(scored, "condition_id", "left").select("condition_id", F.coalesce("n_compared", F.lit(0)).alias("n_compared"), "n_ambiguous", "sign_agreement", "spearman")


def distribution(compared: DataFrame, least: float, places: int = 6) -> DataFrame:
    """One row: conditions compared, quartiles of both figures, and PASS where the median sign agreement reaches ``least``."""
    q = lambda c, p, n: F.round(F.percentile(c, F.lit(p)), places).alias(n)
    row = compared.agg(
        F.count("sign_agreement").alias("n_conditions"), q("sign_agreement", 0.0, "sign_min"), q("sign_agreement", 0.25, "sign_p25"), q("sign_agreement", 0.5, "sign_median"),
        q("sign_agreement", 0.75, "sign_p75"), q("sign_agreement", 1.0, "sign_max"), q("spearman", 0.5, "spearman_median"),
    )
    return row.withColumn("status", F.when(F.col("sign_median") >= least, "PASS").otherwise("FAIL"))
