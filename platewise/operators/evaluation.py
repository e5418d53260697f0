"""Evaluation data: gene universe, eligible lines, differential-expression sets, scoring set, splits, dense targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.functions.text import strip_blanks
from platewise.operators.contracts import ContractError


def gene_universe(dictionary: DataFrame, panel_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes of the dictionary (gene, gene_symbol) whose symbol is in the panel, the smallest gene per symbol; and one row of counters."""
    symbols = panel_symbols.select("gene_symbol").filter("gene_symbol is not null").distinct()
    once = dictionary.filter("gene_symbol is not null").groupBy("gene_symbol").agg(F.min("gene").alias("gene"), F.count(F.lit(1)).alias("n"))
    universe = once.join(symbols, "gene_symbol", "left_semi").select("gene", "gene_symbol")
    counters = (
        symbols.join(once, "gene_symbol", "left")
        .agg(F.count(F.lit(1)).alias("n_panel"), F.count_if(F.col("gene").isNull()).alias("n_not_in_dictionary"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("n_duplicates"))
    )
    return universe, counters


def eligible_lines(conditions: DataFrame, with_result: DataFrame, least: float = 0.5) -> DataFrame:
    """Cell lines where at least a share ``least`` of the treated conditions has a result: (cell_line, fraction)."""
    flagged = conditions.filter(~F.col("is_control")).join(with_result.select("condition_id").distinct().withColumn("has", F.lit(1.0)), "condition_id", "left")
    return flagged.groupBy("cell_line").agg(F.round(F.avg(F.coalesce("has", F.lit(0.0))), 9).alias("fraction")).filter(F.col("fraction") >= least)


def significant(de: DataFrame, below: float = 0.05) -> DataFrame:
    """DE rows with both numbers present (no null, no NaN) and padj strictly below ``below``; symbols without blanks around them."""
    good = (F.col("padj") < below) & F.col("padj").isNotNull() & ~F.isnan("padj") & F.col("log2foldchange").isNotNull() & ~F.isnan("log2foldchange")
    return de.filter(good & F.col("condition_id").isNotNull() & F.col("gene_symbol").isNotNull()).withColumn("gene_symbol", strip_blanks("gene_symbol"))


def de_sets(de: DataFrame, universe: DataFrame | None = None, below: float = 0.05, most: int = 200) -> DataFrame:
    """(condition_id, gene_symbol, log2foldchange, padj, rank): per condition the ``most`` genes with the smallest padj, then larger size of change, then symbol.

    A gene counts once, by its best row. The window's limit is applied before the exchange, so a condition with very many candidates costs little."""
    rows = significant(de, below)
    if universe is not None:
        rows = rows.join(universe.select("gene_symbol"), "gene_symbol", "left_semi")
    best = rows.groupBy("condition_id", "gene_symbol").agg(F.min(F.struct(F.col("padj"), (-F.abs("log2foldchange")).alias("size"), F.col("log2foldchange").alias("lfc"))).alias("b"))
    flat = best.select("condition_id", "gene_symbol", F.col("b.lfc").alias("log2foldchange"), F.col("b.padj").alias("padj"))
    order = Window.partitionBy("condition_id").orderBy(F.col("padj"), F.abs("log2foldchange").desc(), F.col("gene_symbol"))
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def scoring_reasons(view: DataFrame, lines: DataFrame, sets: DataFrame, least: int = 20) -> DataFrame:
    """(condition_id, reason): the first reason that keeps a condition out of scoring, null for kept ones."""
    sizes = sets.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_de"))
    ok = lines.select("cell_line").distinct().withColumn("eligible", F.lit(True))
    joined = view.join(ok, "cell_line", "left").join(sizes, "condition_id", "left")
    reason = (
        F.when(F.col("is_control"), "control")
        .when(F.col("eligible").isNull(), "ineligible_line")
        .when(~F.coalesce(F.col("features_complete"), F.lit(False)), "features_incomplete")
        .when(F.col("n_de").isNull(), "no_de_set")
        .when(F.col("n_de") < least, "below_min_de_genes")
    )
    return joined.select("condition_id", reason.alias("reason"))


def forbidden_test_lines(view: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that must not be tested: ineligible ones, and those with a treated condition whose features are incomplete."""
    every = view.select("cell_line").filter("cell_line is not null").distinct()
    incomplete = view.filter(~F.col("is_control") & ~F.coalesce(F.col("features_complete"), F.lit(False))).select("cell_line").distinct()
    return every.join(lines.select("cell_line"), "cell_line", "left_anti").union(incomplete).distinct()


def draw_units(units: DataFrame, unit: str, repeats: int, kind: str, test: float = 0.20, val: float = 0.15) -> DataFrame:
    """(repeat, ``unit``, part): units in the order of md5(repeat | kind | unit); the first max(1, round(test n)) are test, the next max(1, round(val n)) val.

    Sizes round halves to even. The order is global within a repeat, so it is numbered by buckets of the hash's first byte: counts per bucket give the offsets, and
    only within a bucket are units numbered."""
    tried = units.select(unit).filter(F.col(unit).isNotNull()).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = tried.withColumn("h", F.md5(F.concat_ws("|", F.col("repeat").cast("string"), F.lit(kind), F.col(unit).cast("string")))).withColumn("byte", F.substring("h", 1, 2))
    counts = hashed.groupBy("repeat", "byte").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows a repeat
    w = Window.partitionBy("repeat")
    offsets = counts.withColumn("start", F.sum("n").over(w.orderBy("byte")) - F.col("n")).withColumn("total", F.sum("n").over(w)).drop("n")
    placed = hashed.join(F.broadcast(offsets), ["repeat", "byte"]).withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("repeat", "byte").orderBy("h", unit)))
    size = lambda share: F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(share)).cast("long"))
    part = F.when(F.col("place") <= size(test), "test").when(F.col("place") <= size(test) + size(val), "val").otherwise("train")
    return placed.select("repeat", unit, part.alias("part"))


def make_splits(conditions: DataFrame, repeats: int = 5) -> DataFrame:
    """(repeat, split, condition_id, part) for ``conditions`` (condition_id, cell_line, cluster): by condition, by cluster, by line, and by both.

    Where both must be unseen a condition is kept only if its line's and its cluster's part are the same. A condition without a unit has no row in that split."""
    c = conditions.select("condition_id", "cell_line", "cluster")
    random = draw_units(c, "condition_id", repeats, "condition").select("repeat", F.lit("random").alias("split"), "condition_id", "part")
    by_cluster = c.join(draw_units(c, "cluster", repeats, "cluster"), "cluster").select("repeat", "condition_id", "part")
    by_line = c.join(draw_units(c, "cell_line", repeats, "cell_line"), "cell_line").select("repeat", "condition_id", "part")
    both = by_line.join(by_cluster.withColumnRenamed("part", "other"), ["repeat", "condition_id"]).filter("part = other")
    name = lambda df, s: df.select("repeat", F.lit(s).alias("split"), "condition_id", "part")
    return random.union(name(by_cluster, "unseen_drug")).union(name(by_line, "unseen_cell_line")).union(name(both, "both_unseen"))


def split_sizes(splits: DataFrame, conditions: DataFrame) -> DataFrame:
    """Per repeat and split: conditions per part (0 where none) and different lines and clusters."""
    counted = splits.groupBy("repeat", "split").pivot("part", ["train", "val", "test"]).count().fillna(0)
    units = splits.join(conditions, "condition_id").groupBy("repeat", "split").agg(F.countDistinct("cell_line").alias("n_lines"), F.countDistinct("cluster").alias("n_clusters"))
    return counted.join(units, ["repeat", "split"])


def best_values(de: DataFrame) -> DataFrame:
    """(condition_id, gene_symbol, y): one change per condition and gene, that of the row with the smallest padj (then larger size)."""
    rows = de.filter(F.col("condition_id").isNotNull() & F.col("gene_symbol").isNotNull() & S.finite("log2foldchange")).withColumn("gene_symbol", strip_blanks("gene_symbol"))
    padj = F.when(S.finite("padj"), F.col("padj")).otherwise(F.lit(2.0))
    return rows.groupBy("condition_id", "gene_symbol").agg(F.min(F.struct(padj.alias("p"), (-F.abs("log2foldchange")).alias("s"), F.col("log2foldchange").alias("y"))).alias("b")).select("condition_id", "gene_symbol", F.col("b.y").alias("y"))


def dense_targets(values: DataFrame, conditions: DataFrame, genes: Sequence[str]) -> DataFrame:
    """(condition_id, y array<float>) with one entry per gene of ``genes`` in that order; a gene without a value is exactly 0.

    Only conditions of ``conditions`` come back, each once, also those without any value. A dense row is as long as the gene list, so the list has to fit a row."""
    order = {g: i for i, g in enumerate(genes)}
    spark = values.sparkSession
    slots = spark.createDataFrame([(g, i) for g, i in order.items()], "gene_symbol string, slot int")
    wanted = values.join(slots, "gene_symbol").select("condition_id", "slot", F.col("y").cast("float").alias("y"))
    packed = wanted.groupBy("condition_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "y"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0).cast("float")))
    return conditions.select("condition_id").distinct().join(packed, "condition_id", "left").select("condition_id", F.when(F.lit(len(order) > 0), filled).otherwise(F.array().cast("array<float>")).alias("y"))


def de_candidates(view: DataFrame, lines: DataFrame, with_result: DataFrame) -> DataFrame:
    """Conditions worth fetching differential expression for: treated, of an eligible line, features complete, with a result of their own."""
    good = view.filter(~F.col("is_control") & F.coalesce(F.col("features_complete"), F.lit(False)))
    return good.join(lines.select("cell_line"), "cell_line", "left_semi").join(with_result.select("condition_id"), "condition_id", "left_semi").select("condition_id", "cell_line")


def slice_lines(screened: DataFrame, known: DataFrame, declared: DataFrame) -> DataFrame:
    """(cell_line, n_conditions, external_id, declared, undeclared_gap): every screened line with its external id; a line without one that is not in ``declared`` (cell_line) is an undeclared gap."""
    counted = screened.filter("cell_line is not null").groupBy("cell_line").agg(F.count(F.lit(1)).alias("n_conditions"))
    ids = known.filter("external_id is not null").groupBy("cell_line").agg(F.min("external_id").alias("external_id"))
    stated = declared.select("cell_line").distinct().withColumn("stated", F.lit(True))
    joined = counted.join(ids, "cell_line", "left").join(stated, "cell_line", "left").withColumn("declared", F.coalesce("stated", F.lit(False)))
    return joined.select("cell_line", "n_conditions", "external_id", "declared", (F.col("external_id").isNull() & ~F.col("declared")).alias("undeclared_gap"))


def require_slice(lines: DataFrame) -> None:
    """Raises where :func:`slice_lines` found an undeclared gap."""
    missing = lines.filter("undeclared_gap").limit(3).collect()
    if missing:
        raise ContractError(f"lines without an external id that are not declared: {[r['cell_line'] for r in missing]}")
