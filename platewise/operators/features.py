"""Drug and cell-line features, similarity, groups, principal components, and the condition-feature view."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.operators.contracts import ContractError
from platewise.session import materialize

# ---------------------------------------------------------------------------------------------------------------------
# Fingerprints
# ---------------------------------------------------------------------------------------------------------------------


def nearest_fingerprints(queries: DataFrame, rows: DataFrame, name: str, counts: str, block: int = 512) -> DataFrame:
    """(query, ``name``, similarity): for each query the most similar other row by count-Tanimoto; ties go to the smaller name.

    A stated query set is held against all rows: queries go out in blocks of ``block`` (bounded), every task keeps its own best row per query, and the final choice is an
    aggregation over one candidate a task. Rows with a null name or fingerprint do not take part; all-zero pairs have similarity 0."""
    spark = rows.sparkSession
    key = rows.schema[name].dataType.simpleString()
    parts: DataFrame | None = None
    held: list[tuple] = []

    def best_of(some: list[tuple]) -> DataFrame:
        ids = [r[0] for r in some]
        matrix = spark.sparkContext.broadcast(np.array([r[1] for r in some], dtype=np.int32))
        sizes = matrix.value.sum(axis=1)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = matrix.value
            best: dict[int, tuple] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                names = pdf["n"].to_numpy()
                m = np.stack(pdf["c"].to_numpy()).astype(np.int32)
                total = m.sum(axis=1)
                for i, own in enumerate(ids):
                    low = np.minimum(m, q[i]).sum(axis=1)
                    high = total + sizes[i] - low
                    sim = np.divide(low, high, out=np.zeros(len(m)), where=high > 0)
                    sim[names == own] = -1.0
                    top = sim.max()
                    if top >= 0:
                        cand = (-top, names[sim == top].min())
                        if i not in best or cand < best[i]:
                            best[i] = cand
            yield pd.DataFrame([(ids[i], n, -s) for i, (s, n) in best.items()], columns=["query", name, "similarity"])

        return rows.select(F.col(name).alias("n"), F.col(counts).alias("c")).filter("n is not null and c is not null").mapInPandas(search, f"query {key}, {name} {key}, similarity double")

    for r in queries.select(name, counts).filter(F.col(name).isNotNull() & F.col(counts).isNotNull()).toLocalIterator():
        held.append((r[0], list(r[1])))
        if len(held) == block:
            some = best_of(held)
            parts = some if parts is None else parts.union(some)
            held = []
    if held or parts is None:
        some = best_of(held)
        parts = some if parts is None else parts.union(some)
    per = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col(name))
    return parts.withColumn("nth", F.row_number().over(per)).filter("nth = 1").drop("nth")


def similar_pairs(rows: DataFrame, name: str, counts: str, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: pairs with count-Tanimoto of at least ``threshold``, found by prefix filtering (the higher the threshold, the shorter the prefixes).

    A fingerprint is a set of (slot, level) units. Ordered from the rarest unit, two sets that reach the threshold must share a unit within their first
    |x| - ceil(t |x|) + 1 units, so only rows that share such a prefix unit are compared, and lengths must lie within the threshold of each other."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    base = rows.select(F.col(name).alias("id"), F.col(counts).alias("c")).filter("id is not null and c is not null")
    unfolded = base.select("id", F.posexplode("c").alias("slot", "n")).filter("n > 0")
    units = unfolded.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.col("slot") * 1000 + k)).alias("unit"))
    rare = units.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        units.join(rare, "unit")
        .withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("df", "unit")))
        .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("id")))
    )
    prefix = ranked.filter(F.col("pos") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1).select("id", "unit", "size")
    # a unit that very many rows have in their prefix is spread over several join keys, so no task compares all its rows
    often = prefix.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / 2000).alias("ways"))
    spread = prefix.join(often, "unit")
    a = spread.select(F.col("id").alias("a"), "unit", F.col("size").alias("sa"), F.pmod(F.xxhash64("id"), F.col("ways")).alias("way"))
    b = spread.select(F.col("id").alias("b"), "unit", F.col("size").alias("sb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)).alias("way"))
    close = a.join(b, ["unit", "way"]).filter((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= F.lit(threshold) * F.greatest("sa", "sb"))).select("a", "b").distinct()
    full = close.join(base.toDF("a", "ca"), "a").join(base.toDF("b", "cb"), "b")
    return full.select("a", "b", S.count_tanimoto(F.col("ca"), F.col("cb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def _pieces(text: str, k: int) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(k)))
    return F.filter(cut, lambda x: F.length(x) == k)


def text_similarity(texts: DataFrame, name: str, text: str, lengths: Sequence[int] = (1, 2)) -> DataFrame:
    """(``name``, other, similarity) of all pairs of ``texts`` that share a piece, each with itself: count-Tanimoto of the counts of all pieces of ``lengths`` characters.

    Pairs meet in the pieces they share, so texts without a common piece (similarity 0) give no row. Null and empty texts have no pieces; names must be unique."""
    held = texts.filter(F.length(text) > 0).select(name, F.explode(F.concat(*[_pieces(text, k) for k in lengths])).alias("gram"))
    grams = materialize(held.groupBy(name, "gram").agg(F.count(F.lit(1)).alias("n")), "text-pieces")
    sizes = grams.groupBy(name).agg(F.sum("n").alias("total"))
    shared = grams.join(grams.select(F.col(name).alias("other"), "gram", F.col("n").alias("m")), "gram").groupBy(name, "other").agg(F.sum(F.least("n", "m")).alias("low"))
    both = shared.join(sizes, name).join(sizes.select(F.col(name).alias("other"), F.col("total").alias("total_other")), "other")
    return both.select(name, "other", (F.col("low") / (F.col("total") + F.col("total_other") - F.col("low"))).alias("similarity"))


def text_units(texts: DataFrame, name: str, text: str, lengths: Sequence[int] = (1, 2)) -> DataFrame:
    """(``name``, units): the pieces of :func:`text_similarity`, each with the number of its occurrence, so that the count-Tanimoto of two texts is shared units over all different units.

    Null and empty texts have no row; names must be unique."""
    held = texts.filter(F.length(text) > 0).select(name, F.explode(F.concat(*[_pieces(text, k) for k in lengths])).alias("gram"))
    counted = held.groupBy(name, "gram").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.col("gram"), F.lit("#"), i.cast("string")))).alias("unit")).groupBy(name).agg(F.collect_list("unit").alias("units"))


def butina_groups(names: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
    """(``name``, ``centre``): greedy grouping by the most unassigned neighbours (ties: smaller name), as Spark rounds.

    The sequential greedy choice only ever depends on names within two steps, so all names that are best within two steps are centres at once; the result is
    the same as taking them one by one. Each round is two aggregations over the remaining pairs, written to the shared folder; the best of all names left is always a centre, so every round
    takes some away, and rounds go on until no pair is left."""
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    left = materialize(names.select(F.col(name).alias("n")).distinct(), "butina-left")
    edges = materialize(both, "butina-edges")
    done: DataFrame | None = None
    while edges.limit(1).count():
        degree = left.join(edges.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("d")), "n", "left").select("n", F.coalesce("d", F.lit(0)).alias("d"))
        score = degree.select("n", F.struct((-F.col("d")).alias("d"), F.col("n").alias("who")).alias("s"))
        near = edges.join(score.withColumnRenamed("n", "b"), "b").groupBy("a").agg(F.min("s").alias("m"))
        one = score.join(near.withColumnRenamed("a", "n"), "n", "left").select("n", F.least("s", F.coalesce("m", "s")).alias("one"), "s")
        far = edges.join(one.select(F.col("n").alias("b"), "one"), "b").groupBy("a").agg(F.min("one").alias("m"))
        two = one.join(far.withColumnRenamed("a", "n"), "n", "left").select("n", "s", F.least("one", F.coalesce("m", "one")).alias("best"))
        centres = two.filter("best.who = n").select(F.col("n").alias("centre"))
        members = edges.join(centres, edges["a"] == centres["centre"]).select(F.col("b").alias("n"), "centre").union(centres.select("centre", "centre"))
        # a name next to a centre has no other centre within reach, so it gets exactly one
        members = materialize(members.groupBy("n").agg(F.min("centre").alias("centre")), "butina-members")
        done = members if done is None else done.union(members)
        gone = members.select("n")
        left = materialize(left.join(gone, "n", "left_anti"), "butina-left")
        edges = materialize(edges.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti"), "butina-edges")
    single = left.select("n", F.col("n").alias("centre"))
    return (single if done is None else done.union(single)).withColumnRenamed("n", name)


def cluster_table(groups: DataFrame, name: str) -> DataFrame:
    """(``name``, cluster_size, centre)."""
    sizes = groups.groupBy("centre").agg(F.count(F.lit(1)).alias("cluster_size"))
    return groups.join(sizes, "centre").select(name, "centre", "cluster_size")


# ---------------------------------------------------------------------------------------------------------------------
# Long numeric panels
# ---------------------------------------------------------------------------------------------------------------------


def frequent_columns(panel: DataFrame, least: float) -> DataFrame:
    """(gene, frequency): genes of a long panel (row_id, gene, value) that are positive in at least a share ``least`` of their rows."""
    return panel.groupBy("gene").agg(F.round(F.avg((F.col("value") > 0).cast("double")), 9).alias("frequency")).filter(F.col("frequency") >= least)


def driver_genes(table: DataFrame, gene: str, line: str, least: int) -> DataFrame:
    """Genes stated for at least ``least`` different cell lines, with the lines."""
    return (
        table.filter(F.col(gene).isNotNull())
        .groupBy(gene)
        .agg(F.countDistinct(line).alias("n_lines"), F.array_join(F.array_sort(F.collect_set(line)), ",").alias("lines"))
        .filter(F.col("n_lines") >= least)
    )


def pca_fit(panel: DataFrame, k: int) -> DataFrame:
    """(gene, mean, std, loading array, explained array): the ``k`` first principal components of a long panel (row_id, gene, value), standardised per gene; a missing value counts as the mean.

    Rows become sparse vectors of their standardised values, and Spark's distributed singular value decomposition finds the components, for any number of genes and rows. Only the loadings (genes x k)
    come to the driver. Of a component the largest loading by size is positive; constant genes have loading 0; fewer components come back where the panel has no more."""
    spark = panel.sparkSession
    kind = panel.schema["gene"].dataType.simpleString()
    out = f"gene {kind}, mean double, std double, loading array<double>, explained array<double>"
    per = panel.groupBy("gene").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).filter("mean is not null")
    per = per.select("gene", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("std"))
    # one number per gene, in order: as many rows as a panel has columns
    slots = materialize(per.withColumn("slot", F.row_number().over(Window.orderBy("gene")) - 1), "pca-genes")
    genes = slots.orderBy("slot").collect()
    z = panel.join(slots, "gene").select("row_id", "slot", ((F.col("value") - F.col("mean")) / F.col("std")).alias("z")).filter("z <> 0")
    packed = materialize(z.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("slot", "z"))).alias("e")), "pca-rows")
    total = packed.select(F.explode("e").alias("e")).agg(F.sum(F.col("e.z") * F.col("e.z"))).first()[0]
    if not total:
        return spark.createDataFrame([(r["gene"], r["mean"], r["std"], [], []) for r in genes], out)
    size = len(genes)
    vectors = packed.select("e").rdd.map(lambda r: Vectors.sparse(size, [x["slot"] for x in r["e"]], [x["z"] for x in r["e"]]))
    svd = RowMatrix(vectors, packed.count(), size).computeSVD(min(k, size))
    loadings, explained = svd.V.toArray(), (np.asarray(svd.s) ** 2 / total).tolist()
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    loadings = loadings * np.where(top < 0, -1.0, 1.0)
    return spark.createDataFrame([(r["gene"], float(r["mean"]), float(r["std"]), [float(x) for x in loadings[i]], explained) for i, r in enumerate(genes)], out)


def pca_project(panel: DataFrame, loadings: DataFrame) -> DataFrame:
    """(row_id, component, score) of a long panel by stored means, deviations and loadings; genes outside the loadings are ignored."""
    parts = panel.join(loadings, "gene").select("row_id", ((F.col("value") - F.col("mean")) / F.col("std")).alias("z"), F.posexplode("loading").alias("component", "w"))
    return parts.groupBy("row_id", "component").agg(F.sum(F.col("z") * F.col("w")).alias("score"))


# ---------------------------------------------------------------------------------------------------------------------
# Cell lines and the view
# ---------------------------------------------------------------------------------------------------------------------


def cell_features(lines: DataFrame, scores: DataFrame, flags: DataFrame, absent: Mapping[str, str], proxies: Mapping[str, str]) -> DataFrame:
    """One row per cell line: availability, source, and the long (feature, value) pairs as a map.

    ``lines`` (cell_line, depmap_id); ``scores`` (depmap_id, feature, value); ``flags`` (depmap_id, feature, value > 0 counts as set). A line without expression must have a
    declared proxy or a declared absence; else :class:`ContractError`."""
    proxy = F.create_map(*[F.lit(x) for kv in proxies.items() for x in kv]) if proxies else F.create_map().cast("map<string,string>")
    reason = F.create_map(*[F.lit(x) for kv in absent.items() for x in kv]) if absent else F.create_map().cast("map<string,string>")
    base = lines.select("cell_line", "depmap_id", F.coalesce(F.try_element_at(proxy, F.col("cell_line")), F.col("depmap_id")).alias("source_id"), F.try_element_at(reason, F.col("cell_line")).alias("depmap_absent_reason"))
    have = scores.select(F.col("depmap_id").alias("source_id")).distinct().withColumn("expression_available", F.lit(True))
    joined = base.join(have, "source_id", "left").fillna({"expression_available": False})
    gap = joined.filter(~F.col("expression_available") & F.col("depmap_absent_reason").isNull()).limit(3).collect()
    if gap:
        raise ContractError(f"cell lines without expression and without a declared reason: {[r['cell_line'] for r in gap]}")
    long = scores.union(flags.select("depmap_id", "feature", (F.col("value") > 0).cast("double")))
    features = long.groupBy(F.col("depmap_id").alias("source_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("features"))
    return joined.join(features, "source_id", "left").select(
        "cell_line", "depmap_id", F.col("depmap_id").isNotNull().alias("depmap_available"), "depmap_absent_reason", "expression_available", F.col("source_id").alias("expression_source"), "features"
    )


def pivot_features(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide form of chosen features (missing ones are 0)."""
    return cells.select("cell_line", *[F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def condition_features(conditions: DataFrame, drugs: DataFrame, groups: DataFrame, cells: DataFrame) -> DataFrame:
    """The view: conditions with drug, group and cell-line features, log10 dose in micromolar, the gap (first that applies) and whether features are complete.

    Keys match without the spaces around them. Dimension sides are broadcast by size estimate only; nothing is stored. An unknown dose unit raises."""
    micromolar = S.to_micromolar("dose", "unit")
    d = drugs.withColumn("__d", F.trim("drug")).drop("drug")
    g = groups.withColumn("__g", F.trim("drug")).drop("drug")
    joined = (
        conditions.withColumn("log10_dose_um", S.log10_dose(F.col("is_control"), micromolar))
        .join(d, F.trim(F.col("drug")) == F.col("__d"), "left")
        .join(g, F.trim(F.col("drug")) == F.col("__g"), "left")
        .join(cells.drop("depmap_id"), "cell_line", "left")
        .drop("__d", "__g")
    )
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    gap = (
        F.when(F.col("is_control"), "control")
        .when(no("featurizable"), "drug_not_featurizable")
        .when(no("depmap_available"), "no_depmap")
        .when(no("expression_available"), "no_expression")
    )
    return joined.withColumn("feature_gap", gap).withColumn("features_complete", F.col("feature_gap").isNull())
