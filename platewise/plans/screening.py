"""Queries of the screening domain over the delivered tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.functions.text import lower_key, plate_key, split_key, sql_plate, sql_strip, strip_blanks, upper_key
from platewise.operators import conditions as C
from platewise.operators import contracts, crosscheck, evaluation, exports, features, harness, pseudobulk, quality, ridge, stats
from platewise.session import materialize, scratch_path, table
from platewise.sources import readers
from platewise.streaming import ingest

MIN_CELLS, MIN_CONTROL = 3, 5
REPEATS = 5

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------------------------------------------------

_RE = S.DOSE_PATTERN.replace("'", "''")
_KEY = lambda c: f"lower({sql_strip(c)})"
_UP = lambda c: f"upper({sql_strip(c)})"
_C = f"c AS MATERIALIZED (SELECT {_KEY('sample')} AS sample, {sql_plate('plate')} AS plate, {_UP('cell_line')} AS cell_line, genes, expressions FROM shard_cells)"
_SUMS = """sums AS MATERIALIZED (SELECT sample, plate, cell_line, gene, sum(CAST(amount AS DOUBLE)) AS total FROM (SELECT sample, plate, cell_line, unnest(genes) AS gene, unnest(expressions) AS amount FROM c)
    WHERE gene IS NOT NULL AND amount IS NOT NULL AND gene <> 1 GROUP BY ALL)"""
_W = f"""w AS (SELECT DISTINCT {_KEY("sample")} AS sample, {sql_plate("plate")} AS plate, {_UP("cell_line")} AS cell_line, {_KEY("drug")} AS drug, drugname_drugconc AS t, n_cells
      FROM wells WHERE cell_line IS NOT NULL AND drugname_drugconc IS NOT NULL),
    p AS (SELECT *, CASE WHEN regexp_matches(t, '{_RE}') THEN regexp_extract(t, '{_RE}', 1) WHEN t <> '' THEN t END AS drug_name,
      CASE WHEN regexp_matches(t, '{_RE}') THEN CAST(regexp_extract(t, '{_RE}', 2) AS DOUBLE) END AS dose, CASE WHEN regexp_matches(t, '{_RE}') THEN regexp_extract(t, '{_RE}', 3) END AS unit FROM w),
    q AS MATERIALIZED (SELECT *, coalesce({_KEY("drug_name")} = 'dmso_tf', false) AS is_control,
      substr(sha1(cell_line || '|' || coalesce(drug_name, 'None') || '|' || coalesce(CAST(dose AS VARCHAR), 'None') || '|' || coalesce(plate, 'None')), 1, 16) AS condition_id FROM p),
    cond AS MATERIALIZED (SELECT condition_id, cell_line, drug, drug_name, dose, unit, is_control, plate, CAST(sum(n_cells) AS BIGINT) AS n_cells_atlas FROM q GROUP BY ALL),
    lk AS MATERIALIZED (SELECT sample, plate, cell_line, min(condition_id) AS condition_id FROM q GROUP BY ALL)"""
_PB = """pb0 AS (SELECT condition_id, gene, sum(total) AS total FROM sums JOIN lk USING (sample, plate, cell_line) GROUP BY ALL),
    nc AS MATERIALIZED (SELECT condition_id, CAST(count(*) AS INTEGER) AS n_cells FROM c JOIN lk USING (sample, plate, cell_line) GROUP BY 1),
    pb AS MATERIALIZED (SELECT condition_id, CAST(gene AS INTEGER) AS gene, CAST(total AS INTEGER) AS sum_counts, n_cells, CAST(sum(total) OVER (PARTITION BY condition_id) AS BIGINT) AS library_size
      FROM pb0 JOIN nc USING (condition_id))"""
_CQ = f"""ct AS (SELECT cell_line, plate, condition_id AS control_condition_id FROM cond WHERE is_control),
    cq AS MATERIALIZED (SELECT cond.*, coalesce(n_cells, 0) AS n_cells, control_condition_id, coalesce(n_cells, 0) >= CASE WHEN is_control THEN {MIN_CONTROL} ELSE {MIN_CELLS} END AS qc_pass
      FROM cond LEFT JOIN ct USING (cell_line, plate) LEFT JOIN nc USING (condition_id))"""
_BASE = f"WITH {_C}, {_SUMS}, {_W}, {_PB}, {_CQ}"


# ---------------------------------------------------------------------------------------------------------------------
# Cells to log fold-changes
# ---------------------------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return pseudobulk.clean_cells(pseudobulk.spread(table(spark, sf, "shard_cells")))


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    return C.condition_lookup(table(spark, sf, "wells"))


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and cell numbers per condition, from one scan of the cells, written once."""
    return pseudobulk.condition_totals(_cells(spark, sf), _lookup(spark, sf))


def _bulk(spark: SparkSession, sf: str) -> DataFrame:
    return pseudobulk.profiles(_totals(spark, sf))


def _conditions_of(spark: SparkSession, sf: str, n_cells: DataFrame) -> DataFrame:
    """Conditions with their control, processed cells and quality flag."""
    named = quality.with_processed_cells(C.assign_controls(C.condition_table(table(spark, sf, "wells"))), n_cells)
    return quality.qc_flags(named, MIN_CELLS, MIN_CONTROL)


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the cells' keys alone, where no sums are needed."""
    n_cells = pseudobulk.cells_per_well(_cells(spark, sf)).join(_lookup(spark, sf), C.WELL).groupBy("condition_id").agg(F.sum("n_cells").cast("int").alias("n_cells"))
    return _conditions_of(spark, sf, n_cells)


@query(f"WITH {_C}, {_SUMS} SELECT * FROM sums")
def sparse_unnest_sum(spark, sf):
    return pseudobulk.sums_per_well(_cells(spark, sf))


@query(f"WITH {_C} SELECT sample, plate, cell_line, count(*) AS n_cells FROM c GROUP BY ALL")
def cells_per_well(spark, sf):
    return pseudobulk.cells_per_well(_cells(spark, sf))


@query(f"WITH {_C}, {_SUMS}, {_W}, {_PB} SELECT * FROM pb")
def pseudobulk_profiles(spark, sf):
    return _bulk(spark, sf)


@query(f"WITH {_W} SELECT DISTINCT t AS drugname_drugconc, drug_name, dose, unit, is_control FROM q")
def parse_drug_dose(spark, sf):
    return C.parsed_wells(C.clean_wells(table(spark, sf, "wells"))).select("drugname_drugconc", "drug_name", "dose", "unit", "is_control").distinct()


@query(f"WITH {_W} SELECT * FROM cond")
def condition_table(spark, sf):
    return C.condition_table(table(spark, sf, "wells"))


@query(f"WITH {_W} SELECT * FROM lk")
def condition_lookup(spark, sf):
    return _lookup(spark, sf)


@query(f"WITH {_W} SELECT condition_id, is_control, control_condition_id FROM cond LEFT JOIN (SELECT cell_line, plate, condition_id AS control_condition_id FROM cond WHERE is_control) USING (cell_line, plate)")
def assign_controls(spark, sf):
    return C.assign_controls(C.condition_table(table(spark, sf, "wells"))).select("condition_id", "is_control", "control_condition_id")


@query(f"{_BASE} SELECT condition_id, is_control, n_cells_atlas, CAST(n_cells AS INTEGER) AS n_cells, qc_pass FROM cq")
def qc_flags(spark, sf):
    return _checked(spark, sf).select("condition_id", "is_control", "n_cells_atlas", "n_cells", "qc_pass")


@query(f"""{_BASE}, l AS (SELECT DISTINCT condition_id, library_size FROM pb)
    SELECT cell_line, count(*) AS n_conditions, CAST(sum(CAST(qc_pass AS INTEGER)) AS BIGINT) AS n_kept, median(CAST(n_cells AS DOUBLE)) AS median_cells,
      median(CASE WHEN qc_pass THEN CAST(library_size AS DOUBLE) END) AS median_library FROM cq LEFT JOIN l USING (condition_id) GROUP BY 1""")
def qc_per_line(spark, sf):
    summed = _totals(spark, sf)
    return quality.per_line(_conditions_of(spark, sf, pseudobulk.cell_numbers(summed)), pseudobulk.profiles(summed).select("condition_id", "library_size").distinct())


@query(f"""{_BASE} SELECT condition_id, CASE WHEN is_control THEN 'control' ELSE 'treated' END || ' condition with ' || CAST(n_cells AS VARCHAR) || ' cells, '
      || CAST(CASE WHEN is_control THEN {MIN_CONTROL} ELSE {MIN_CELLS} END AS VARCHAR) || ' needed' AS reason FROM cq WHERE NOT qc_pass""")
def qc_dropped(spark, sf):
    return quality.dropped(_checked(spark, sf), MIN_CELLS, MIN_CONTROL)


@query(f"""{_BASE}, s AS (SELECT count(*) AS n_conditions, count(*) FILTER (qc_pass) AS n_kept, count(*) FILTER (is_control) AS n_controls, count(*) FILTER (is_control AND qc_pass) AS n_controls_kept,
      count(*) FILTER (NOT is_control AND control_condition_id IS NULL) AS n_without_control, coalesce(round(avg(CASE WHEN qc_pass THEN n_cells END), 6), CAST(0 AS DOUBLE)) AS mean_kept_cells FROM cq)
    SELECT *, CASE WHEN n_kept = 0 THEN 'empty' WHEN n_controls_kept < n_controls OR n_without_control > 0 THEN 'warnings' ELSE 'ok' END AS status FROM s""")
def qc_summary(spark, sf):
    return quality.summary(_checked(spark, sf))


@query(f"{_BASE} SELECT cell_line, plate, condition_id AS control_condition_id, CAST(n_cells AS INTEGER) AS n_cells, qc_pass FROM cq WHERE is_control")
def controls(spark, sf):
    return quality.controls(_checked(spark, sf))


@query(f"WITH {_C}, {_SUMS}, {_W}, {_PB} SELECT condition_id, gene, round(CAST(sum_counts AS DOUBLE) / CAST(library_size AS DOUBLE) * 1e6, 4) AS cpm FROM pb")
def cpm(spark, sf):
    return pseudobulk.cpm(_bulk(spark, sf)).withColumn("cpm", F.round("cpm", 4))


_LOGFC = f"""{_BASE}, pairs AS MATERIALIZED (SELECT t.condition_id, t.control_condition_id FROM cq t JOIN cq k ON t.control_condition_id = k.condition_id WHERE t.qc_pass AND k.qc_pass AND NOT t.is_control),
    v AS MATERIALIZED (SELECT condition_id, gene, CAST(sum_counts AS DOUBLE) / CAST(library_size AS DOUBLE) * 1e6 AS cpm FROM pb),
    a AS (SELECT v.* FROM v SEMI JOIN pairs USING (condition_id)), b AS (SELECT pairs.condition_id, gene, cpm FROM pairs JOIN v ON v.condition_id = pairs.control_condition_id),
    j AS (SELECT coalesce(a.condition_id, b.condition_id) AS condition_id, coalesce(a.gene, b.gene) AS gene, ln(1 + coalesce(a.cpm, 0)) - ln(1 + coalesce(b.cpm, 0)) AS x
      FROM a FULL OUTER JOIN b ON a.condition_id = b.condition_id AND a.gene = b.gene),
    lf AS MATERIALIZED (SELECT condition_id, control_condition_id, gene, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 4) AS logfc FROM j JOIN pairs USING (condition_id))"""


def _changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(fold-changes, checked conditions), from one scan of the cells."""
    summed = _totals(spark, sf)
    checked = materialize(_conditions_of(spark, sf, pseudobulk.cell_numbers(summed)), "checked")
    return pseudobulk.log_fold_changes(pseudobulk.profiles(summed), checked), checked


@query(f"{_LOGFC} SELECT * FROM lf")
def logfc(spark, sf):
    out = _changes(spark, sf)[0]
    return out.withColumn("logfc", F.round(F.col("logfc").cast("double"), 4))


@query(f"{_BASE} SELECT gene, count(*) AS n_wells FROM sums ANTI JOIN pb USING (gene) GROUP BY 1")
def gene_coverage(spark, sf):
    """Genes of the cells that no condition covers, and in how many wells they occur."""
    sums = pseudobulk.sums_per_well(_cells(spark, sf))
    return sums.join(_bulk(spark, sf).select(F.col("gene").cast("bigint").alias("gene")).distinct(), "gene", "left_anti").groupBy("gene").agg(F.count(F.lit(1)).alias("n_wells"))


@query(f"""{_BASE}, u AS (SELECT DISTINCT gene FROM sums ANTI JOIN (SELECT gene FROM pb JOIN cq USING (condition_id) WHERE is_control) USING (gene))
    SELECT count(*) AS n_zero_genes, (SELECT string_agg(CAST(gene AS VARCHAR), ',' ORDER BY gene) FROM (SELECT gene FROM u ORDER BY gene LIMIT 20)) AS first_genes FROM u""")
def zero_genes(spark, sf):
    """Genes seen in cells, but in no control."""
    bulk = _bulk(spark, sf).join(C.condition_table(table(spark, sf, "wells")).filter("is_control").select("condition_id"), "condition_id", "left_semi")
    return pseudobulk.zero_genes(bulk.select(F.col("gene").cast("bigint").alias("gene")), pseudobulk.sums_per_well(_cells(spark, sf)))


@query(f"WITH {_C}, {_SUMS}, {_W}, {_PB} SELECT * FROM pb")
def stream_ingest(spark, sf):
    """pseudobulk_profiles by way of incremental ingest and merged partials."""
    schema = table(spark, sf, "shard_cells").schema
    out = scratch_path(spark, "ingest")
    ingest.ingest(spark, f"{sf}/shard_cells.parquet", schema, out, f"{out}/checkpoint").awaitTermination()
    return pseudobulk.merge_partials(ingest.partials(spark, out), _lookup(spark, sf))


# ---------------------------------------------------------------------------------------------------------------------
# Contracts, manifests, counts
# ---------------------------------------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT {sql_plate("plate")} AS plate, {_KEY("sample")} AS sample, {_KEY("barcode_sub_lib_id")} AS barcode FROM shard_cells)
    SELECT plate, sample, barcode, count(*) AS n_rows FROM k GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    keyed = table(spark, sf, "shard_cells").select(plate_key("plate").alias("plate"), lower_key("sample").alias("sample"), lower_key("barcode_sub_lib_id").alias("barcode"))
    return contracts.duplicate_groups(keyed, ["plate", "sample", "barcode"])


@query("""SELECT count(*) AS n_rows, count(*) - count(repeat) AS nulls_repeat, count(*) - count(split) AS nulls_split, count(*) - count(de_pearson) AS nulls_de_pearson,
    count(*) FILTER (isnan(de_pearson)) AS nans_de_pearson, count(*) FILTER (isinf(de_pearson)) AS infs_de_pearson, count(*) - count(de_mse) AS nulls_de_mse,
    count(*) FILTER (isnan(de_mse)) AS nans_de_mse, count(*) FILTER (isinf(de_mse)) AS infs_de_mse FROM per_condition""")
def null_profile(spark, sf):
    return contracts.null_profile(table(spark, sf, "per_condition"), ["repeat", "split", "de_pearson", "de_mse"])


@query("""SELECT * FROM (
    SELECT 'conditions' AS table_name, unnest(['null_key', 'external_id', 'negative_cells', 'without_control']) AS rule, count(*) AS n_rows, unnest([count(*) FILTER (condition_id IS NULL OR cell_line IS NULL OR plate IS NULL),
      count(*) FILTER (depmap_id IS NULL), count(*) FILTER (n_cells < 0), count(*) FILTER (NOT is_control AND control_condition_id IS NULL)]) AS n_broken FROM conditions
    UNION ALL SELECT 'splits', unnest(['no_part', 'unknown_condition', 'control_assigned', 'repeated']), count(*), unnest([count(*) FILTER (part IS NULL), count(*) FILTER (c.condition_id IS NULL), count(*) FILTER (c.is_control), count(*) FILTER (k > 1)])
      FROM (SELECT *, row_number() OVER (PARTITION BY repeat, split, condition_id, part) AS k FROM splits) s LEFT JOIN conditions c USING (condition_id)
    UNION ALL SELECT 'de_sets', unnest(['null_key', 'no_number', 'padj_range', 'no_rank']), count(*), unnest([count(*) FILTER (condition_id IS NULL OR gene_symbol IS NULL), count(*) FILTER (padj IS NULL OR isnan(padj) OR log2foldchange IS NULL OR isnan(log2foldchange)),
      count(*) FILTER (NOT isnan(padj) AND (padj < 0 OR padj > 1)), count(*) FILTER (rank IS NULL)]) FROM de_sets)""")
def contract_report(spark, sf):
    """The delivered tables held against their contracts: rows that break each rule."""
    conditions, null = table(spark, sf, "conditions"), lambda *c: F.greatest(*[F.col(x).isNull() for x in c]) if len(c) > 1 else F.col(c[0]).isNull()
    one = contracts.report(conditions, "conditions", {
        "null_key": null("condition_id", "cell_line", "plate"), "external_id": null("depmap_id"), "negative_cells": F.col("n_cells") < 0, "without_control": ~F.col("is_control") & null("control_condition_id"),
    })
    again = F.row_number().over(Window.partitionBy("repeat", "split", "condition_id", "part").orderBy(F.lit(0))) > 1
    assigned = table(spark, sf, "splits").withColumn("again", again).join(conditions.select("condition_id", F.lit(True).alias("known"), "is_control"), "condition_id", "left")
    two = contracts.report(assigned, "splits", {"no_part": null("part"), "unknown_condition": null("known"), "control_assigned": F.col("is_control"), "repeated": F.col("again")})
    number = lambda c: F.col(c).isNull() | F.isnan(c)
    three = contracts.report(table(spark, sf, "de_sets"), "de_sets", {
        "null_key": null("condition_id", "gene_symbol"), "no_number": number("padj") | number("log2foldchange"), "padj_range": ~F.isnan("padj") & ((F.col("padj") < 0) | (F.col("padj") > 1)), "no_rank": null("rank"),
    })
    return one.union(two).union(three)


@query("""SELECT DISTINCT shard FROM shard_files f WHERE EXISTS (SELECT 1 FROM conditions d WHERE d.is_control AND d.n_cells < 1000 AND f.plate_min <= d.plate AND f.plate_max >= d.plate)""")
def shard_prune(spark, sf):
    """Fragments whose (string) plate range may hold a plate with a small control."""
    plates = table(spark, sf, "conditions").filter("is_control and n_cells < 1000").select("plate")
    return readers.prune_shards(table(spark, sf, "shard_files"), plates)


@query("""WITH f AS (SELECT shard, max(num_rows) AS stated FROM shard_files GROUP BY 1), r AS (SELECT shard, count(*) AS n FROM shard_cells WHERE shard IS NOT NULL GROUP BY 1)
    SELECT shard, stated, coalesce(n, 0) AS found FROM f LEFT JOIN r USING (shard) WHERE stated IS DISTINCT FROM coalesce(n, 0)""")
def stale_manifest(spark, sf):
    """Fragments whose manifest states another number of rows than they hold, or none."""
    f = table(spark, sf, "shard_files").groupBy("shard").agg(F.max("num_rows").alias("stated"))
    r = table(spark, sf, "shard_cells").filter("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return f.join(r, "shard", "left").select("shard", "stated", F.coalesce("n", F.lit(0)).alias("found")).filter(~F.col("stated").eqNullSafe(F.col("found")))


@query(f"SELECT {_KEY('drug')} AS drug, count(*) AS n_cells FROM shard_cells GROUP BY 1 ORDER BY n_cells DESC, drug LIMIT 10")
def topn_groups(spark, sf):
    return table(spark, sf, "shard_cells").groupBy(lower_key("drug").alias("drug")).agg(F.count(F.lit(1)).alias("n_cells")).orderBy(F.desc("n_cells"), "drug").limit(10)


@query(f"""SELECT {sql_plate("plate")} AS plate, count(DISTINCT {_KEY("sample")}) AS n_samples, count(DISTINCT {_UP("cell_line")}) AS n_lines, count(DISTINCT {_KEY("drug")}) AS n_drugs FROM shard_cells GROUP BY 1""")
def distinct_counts(spark, sf):
    cells = table(spark, sf, "shard_cells")
    return cells.groupBy(plate_key("plate").alias("plate")).agg(
        F.countDistinct(lower_key("sample")).alias("n_samples"), F.countDistinct(upper_key("cell_line")).alias("n_lines"), F.countDistinct(lower_key("drug")).alias("n_drugs")
    )


@query(f"""WITH k AS (SELECT {_UP("cell_line")} AS cell_line, {sql_plate("plate")} AS plate, coalesce({_KEY("drug")} = 'dmso_tf', false) AS control FROM shard_cells)
    SELECT cell_line, plate, count(*) FILTER (control) AS control_cells, count(*) FILTER (NOT control) AS treated_cells FROM k GROUP BY ALL""")
def conditional_sum(spark, sf):
    k = table(spark, sf, "shard_cells").select(upper_key("cell_line").alias("cell_line"), plate_key("plate").alias("plate"), S.is_control("drug").alias("control"))
    return k.groupBy("cell_line", "plate").agg(F.count_if("control").alias("control_cells"), F.count_if(~F.col("control")).alias("treated_cells"))


# ---------------------------------------------------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------------------------------------------------

_VIEW = f"""k AS (SELECT condition_id, {_UP("cell_line")} AS cell_line, {_KEY("drug")} AS drug, dose, unit, is_control, depmap_id, qc_pass, plate FROM conditions),
    g AS (SELECT {_KEY("drug")} AS drug, min(cluster_id) AS cluster_id, max(cluster_size) AS cluster_size, bool_or(murcko_scaffold IS NOT NULL) AS featurizable FROM drug_groups WHERE drug IS NOT NULL GROUP BY 1),
    ce AS (SELECT cell_line, bool_or(depmap_id IS NOT NULL) AS depmap_available, bool_or(coalesce(qc_pass, false)) AS expression_available FROM k GROUP BY 1),
    v AS (SELECT condition_id, cell_line, drug, is_control, plate, CASE WHEN NOT is_control AND dose > 0 THEN log10(dose * CASE unit WHEN 'nM' THEN 0.001::DOUBLE WHEN 'uM' THEN 1::DOUBLE WHEN 'µM' THEN 1::DOUBLE WHEN 'μM' THEN 1::DOUBLE WHEN 'mM' THEN 1000::DOUBLE END) END AS log10_dose_um,
      cluster_id, cluster_size, CASE WHEN is_control THEN 'control' WHEN NOT coalesce(featurizable, false) THEN 'drug_not_featurizable' WHEN NOT coalesce(depmap_available, false) THEN 'no_depmap'
        WHEN NOT coalesce(expression_available, false) THEN 'no_expression' END AS feature_gap FROM k LEFT JOIN g USING (drug) LEFT JOIN ce USING (cell_line))"""


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conditions")
    return t.withColumns({"cell_line": upper_key("cell_line"), "drug": lower_key("drug")})


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "drug_groups").filter("drug is not null").withColumn("drug", lower_key("drug"))
    return g.groupBy("drug").agg(F.min("cluster_id").alias("cluster_id"), F.max("cluster_size").alias("cluster_size"), F.bool_or(F.col("murcko_scaffold").isNotNull()).alias("featurizable"))


def _view(spark: SparkSession, sf: str) -> DataFrame:
    c, g = _conditions(spark, sf), _groups(spark, sf)
    lines = c.groupBy("cell_line").agg(
        F.bool_or(F.col("depmap_id").isNotNull()).alias("depmap_available"), F.bool_or(F.coalesce(F.col("qc_pass"), F.lit(False))).alias("expression_available"), F.max("depmap_id").alias("depmap_id")
    )
    return features.condition_features(c, g.select("drug", "featurizable"), g.select("drug", "cluster_id", "cluster_size"), lines)


@query(f"WITH {_VIEW} SELECT condition_id, drug, round(log10_dose_um, 9) AS log10_dose_um, cluster_id, cluster_size, feature_gap, feature_gap IS NULL AS features_complete FROM v")
def condition_features(spark, sf):
    return _view(spark, sf).select("condition_id", "drug", F.round("log10_dose_um", 9).alias("log10_dose_um"), "cluster_id", "cluster_size", "feature_gap", "features_complete")


@query(f"WITH {_VIEW} SELECT coalesce(feature_gap, 'complete') AS gap, count(*) AS n FROM v GROUP BY 1")
def feature_gap_counts(spark, sf):
    return _view(spark, sf).groupBy(F.coalesce("feature_gap", F.lit("complete")).alias("gap")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT condition_id, dose * CASE unit WHEN 'nM' THEN 0.001::DOUBLE WHEN 'uM' THEN 1::DOUBLE WHEN 'µM' THEN 1::DOUBLE WHEN 'μM' THEN 1::DOUBLE WHEN 'mM' THEN 1000::DOUBLE END AS micromolar FROM conditions WHERE dose IS NOT NULL AND unit IS NOT NULL""")
def unit_convert(spark, sf):
    return table(spark, sf, "conditions").filter("dose is not null and unit is not null").select("condition_id", S.to_micromolar("dose", "unit").alias("micromolar"))


@query(f"""WITH n AS (SELECT DISTINCT drug FROM conditions WHERE drug IS NOT NULL), k AS (SELECT DISTINCT drug AS k FROM drug_groups WHERE drug IS NOT NULL), l AS (SELECT trim(k, ' ') AS t, min(k) AS loose FROM k GROUP BY 1)
    SELECT drug, coalesce(k, loose) AS matched FROM n LEFT JOIN k ON drug = k LEFT JOIN l ON trim(drug, ' ') = t""")
def name_match(spark, sf):
    return crosscheck.name_match(table(spark, sf, "conditions").select("drug").filter("drug is not null").distinct(), table(spark, sf, "drug_groups"), "drug")


_PANEL = "l AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS gene, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("gene", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_PANEL} SELECT gene, round(avg(CAST(x > 0 AS DOUBLE)), 9) AS frequency FROM l GROUP BY 1 HAVING avg(CAST(x > 0 AS DOUBLE)) >= 0.5")
def mutation_freq(spark, sf):
    return features.frequent_columns(_panel(spark, sf), 0.5)


@query(f"""SELECT drug, count(DISTINCT cell_line) AS n_lines, string_agg(DISTINCT cell_line, ',' ORDER BY cell_line) AS lines FROM (SELECT {_KEY("drug")} AS drug, {_UP("cell_line")} AS cell_line FROM conditions)
    WHERE drug IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cell_line) >= 2""")
def driver_genes(spark, sf):
    """Keys stated for at least two different lines (the conditions' drugs), with the lines."""
    return features.driver_genes(_conditions(spark, sf).select("drug", "cell_line"), "drug", "cell_line", 2)


_FP = "f AS (SELECT vec_id, i, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 20) AS INTEGER) AS n FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20).cast("int")).alias("counts"))


@query(f"""WITH {_FP}, s AS (SELECT a.vec_id AS query, b.vec_id AS vec_id, sum(least(a.n, b.n)) AS lo, sum(greatest(a.n, b.n)) AS hi FROM f a JOIN f b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
    r AS (SELECT query, vec_id, CASE WHEN hi > 0 THEN CAST(lo AS DOUBLE) / CAST(hi AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS sim FROM s)
    SELECT query, vec_id, round(sim, 9) AS similarity FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) = 1""")
def nearest_drug(spark, sf):
    """Every row whose id is divisible by 20 as a query against all rows."""
    f = _fingerprints(spark, sf)
    return features.nearest_fingerprints(f.filter("vec_id % 20 = 0"), f, "vec_id", "counts").withColumn("similarity", F.round("similarity", 9))


SIMILAR = 0.5


@query(f"""WITH {_FP} SELECT a.vec_id AS a, b.vec_id AS b, round(CAST(sum(least(a.n, b.n)) AS DOUBLE) / CAST(sum(greatest(a.n, b.n)) AS DOUBLE), 9) AS similarity FROM f a JOIN f b ON a.i = b.i AND a.vec_id < b.vec_id
    GROUP BY 1, 2 HAVING CAST(sum(least(a.n, b.n)) AS DOUBLE) / CAST(sum(greatest(a.n, b.n)) AS DOUBLE) >= {SIMILAR}""")
def tanimoto(spark, sf):
    return features.similar_pairs(_fingerprints(spark, sf), "vec_id", "counts", SIMILAR).withColumn("similarity", F.round("similarity", 9))


@query()
def butina_clusters(spark, sf):
    f = _fingerprints(spark, sf)
    groups = features.butina_groups(f, "vec_id", features.similar_pairs(f, "vec_id", "counts", SIMILAR))
    return features.cluster_table(groups, "vec_id")


@query(f"""WITH g AS (SELECT DISTINCT {_KEY("drug")} AS drug, cluster_id, cluster_size FROM drug_groups WHERE drug IS NOT NULL)
    SELECT cluster_id, count(DISTINCT drug) AS n_drugs, max(cluster_size) AS stated FROM g WHERE cluster_id IS NOT NULL GROUP BY 1""")
def cluster_sizes(spark, sf):
    g = table(spark, sf, "drug_groups").filter("drug is not null and cluster_id is not null").select(lower_key("drug").alias("drug"), "cluster_id", "cluster_size")
    return g.groupBy("cluster_id").agg(F.countDistinct("drug").alias("n_drugs"), F.max("cluster_size").alias("stated"))


@query()
def pca_scores(spark, sf):
    panel = _panel(spark, sf)
    return features.pca_project(panel, features.pca_fit(panel, 5)).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------------------------------------------------------------
# Evaluation data
# ---------------------------------------------------------------------------------------------------------------------

_OKDE = "condition_id IS NOT NULL AND gene_symbol IS NOT NULL AND log2foldchange IS NOT NULL AND NOT isnan(log2foldchange)"
_DE = f"""s0 AS (SELECT condition_id, {sql_strip("gene_symbol")} AS gene_symbol, log2foldchange, padj FROM de_sets WHERE {_OKDE} AND padj IS NOT NULL AND NOT isnan(padj) AND padj < 0.05),
    s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY condition_id, gene_symbol ORDER BY padj, abs(log2foldchange) DESC, log2foldchange) = 1),
    ds AS (SELECT *, CAST(row_number() OVER (PARTITION BY condition_id ORDER BY padj, abs(log2foldchange) DESC, gene_symbol) AS INTEGER) AS rank FROM s1 QUALIFY rank <= 200)"""


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.de_sets(table(spark, sf, "de_sets"))


@query(f"WITH {_DE} SELECT * FROM ds")
def de_topk(spark, sf):
    return _sets(spark, sf)


@query(f"""WITH d AS (SELECT rank AS gene, {sql_strip("gene_symbol")} AS gene_symbol FROM de_sets WHERE gene_symbol IS NOT NULL AND rank IS NOT NULL), o AS (SELECT gene_symbol, min(gene) AS gene FROM d GROUP BY 1),
    p AS (SELECT DISTINCT {sql_strip("gene_symbol")} AS gene_symbol FROM de_sets WHERE NOT contains(gene_symbol, '.')) SELECT gene, gene_symbol FROM o SEMI JOIN p USING (gene_symbol)""")
def gene_universe(spark, sf):
    de = table(spark, sf, "de_sets").filter("gene_symbol is not null").withColumn("gene_symbol", strip_blanks("gene_symbol"))
    return evaluation.gene_universe(de.filter("rank is not null").select(F.col("rank").alias("gene"), "gene_symbol"), de.filter(~F.col("gene_symbol").contains(".")))[0]


@query(f"""WITH d AS (SELECT {sql_strip("gene_symbol")} AS s FROM de_sets WHERE gene_symbol IS NOT NULL AND rank IS NOT NULL), o AS (SELECT s, count(*) AS n FROM d GROUP BY 1),
    p AS (SELECT DISTINCT {sql_strip("gene_symbol")} AS s FROM de_sets WHERE NOT contains(gene_symbol, '.'))
    SELECT count(*) AS n_panel, count(*) FILTER (n IS NULL) AS n_not_in_dictionary, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS n_duplicates FROM p LEFT JOIN o USING (s)""")
def gene_universe_counters(spark, sf):
    """Symbols of the panel, those the dictionary lacks, and dictionary entries beyond the first of a symbol."""
    de = table(spark, sf, "de_sets").filter("gene_symbol is not null").withColumn("gene_symbol", strip_blanks("gene_symbol"))
    return evaluation.gene_universe(de.filter("rank is not null").select(F.col("rank").alias("gene"), "gene_symbol"), de.filter(~F.col("gene_symbol").contains(".")))[1]


_LINES = f"""k0 AS (SELECT condition_id, {_UP("cell_line")} AS cell_line, is_control FROM conditions),
    el AS (SELECT cell_line, round(avg(CASE WHEN h.condition_id IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 9) AS fraction
      FROM k0 LEFT JOIN (SELECT DISTINCT condition_id FROM ds) h USING (condition_id) WHERE NOT is_control GROUP BY 1 HAVING fraction >= 0.5)"""


@query(f"WITH {_DE}, {_LINES} SELECT * FROM el")
def eligible_lines(spark, sf):
    return evaluation.eligible_lines(_conditions(spark, sf), _sets(spark, sf))


_REASON = f"""nd AS (SELECT condition_id, count(*) AS n FROM ds GROUP BY 1), rs AS (SELECT condition_id, CASE WHEN is_control THEN 'control' WHEN e.cell_line IS NULL THEN 'ineligible_line'
      WHEN feature_gap IS NOT NULL THEN 'features_incomplete' WHEN n IS NULL THEN 'no_de_set' WHEN n < 5 THEN 'below_min_de_genes' END AS reason
      FROM v LEFT JOIN (SELECT cell_line FROM el) e USING (cell_line) LEFT JOIN nd USING (condition_id))"""


@query(f"WITH {_VIEW}, {_DE}, {_LINES}, {_REASON} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM rs GROUP BY 1")
def scoring_exclusions(spark, sf):
    sets = _sets(spark, sf)
    reasons = evaluation.scoring_reasons(_view(spark, sf), evaluation.eligible_lines(_conditions(spark, sf), sets), sets, 5)
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_VIEW}, {_DE}, {_LINES}, {_REASON.replace('n < 5', 'n < 20')} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM rs GROUP BY 1")
def scoring_exclusions_20(spark, sf):
    """scoring_exclusions at the reference's least number of DE genes."""
    sets = _sets(spark, sf)
    reasons = evaluation.scoring_reasons(_view(spark, sf), evaluation.eligible_lines(_conditions(spark, sf), sets), sets)
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_VIEW}, {_DE}, {_LINES} SELECT DISTINCT cell_line FROM v WHERE cell_line IS NOT NULL AND (cell_line NOT IN (SELECT cell_line FROM el WHERE cell_line IS NOT NULL))
    UNION SELECT cell_line FROM v WHERE NOT is_control AND feature_gap IS NOT NULL""")
def forbidden_lines(spark, sf):
    return evaluation.forbidden_test_lines(_view(spark, sf), evaluation.eligible_lines(_conditions(spark, sf), _sets(spark, sf)))


@query(f"WITH {_VIEW}, {_DE}, {_LINES} SELECT condition_id, cell_line FROM v SEMI JOIN el USING (cell_line) WHERE NOT is_control AND feature_gap IS NULL AND condition_id IN (SELECT condition_id FROM ds)")
def de_candidates(spark, sf):
    sets = _sets(spark, sf)
    return evaluation.de_candidates(_view(spark, sf), evaluation.eligible_lines(_conditions(spark, sf), sets), sets)


@query(f"""WITH k AS (SELECT {_UP("cell_line")} AS cell_line, depmap_id, is_control, qc_pass FROM conditions WHERE cell_line IS NOT NULL)
    SELECT cell_line, count(*) AS n_conditions, min(depmap_id) AS external_id, NOT coalesce(bool_or(NOT is_control AND qc_pass), false) AS declared, min(depmap_id) IS NULL AND coalesce(bool_or(NOT is_control AND qc_pass), false) AS undeclared_gap FROM k GROUP BY 1""")
def slice_lines(spark, sf):
    """Screened lines with their external id. Lines without a treated condition that passes are declared to need none; a line that needs one and has none is an undeclared gap."""
    c = _conditions(spark, sf)
    used = F.coalesce(F.bool_or(~F.col("is_control") & F.col("qc_pass")), F.lit(False))
    declared = c.groupBy("cell_line").agg(used.alias("used")).filter("not used").select("cell_line")
    return evaluation.slice_lines(c, c.select("cell_line", F.col("depmap_id").alias("external_id")), declared)


def _draw_sql(unit: str, kind: str, name: str) -> str:
    return f"""{name}u AS (SELECT {unit} AS unit, repeat, md5(CAST(repeat AS VARCHAR) || '|{kind}|' || CAST({unit} AS VARCHAR)) AS h FROM (SELECT DISTINCT {unit} FROM tr WHERE {unit} IS NOT NULL),
        (SELECT CAST(unnest(range({REPEATS})) AS INTEGER) AS repeat)),
    {name}n AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY h, unit) AS place, count(*) OVER (PARTITION BY repeat) AS total FROM {name}u),
    {name} AS (SELECT repeat, unit, CASE WHEN place <= greatest(1, round_even(total * 0.20::DOUBLE, 0)) THEN 'test'
        WHEN place <= greatest(1, round_even(total * 0.20::DOUBLE, 0)) + greatest(1, round_even(total * 0.15::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS part FROM {name}n)"""


_SPLITS = f"""tr AS (SELECT condition_id, cell_line, cluster_id AS cluster FROM v WHERE NOT is_control), {_draw_sql("condition_id", "condition", "dr")}, {_draw_sql("cluster", "cluster", "dc")}, {_draw_sql("cell_line", "cell_line", "dl")},
    sp AS (SELECT repeat, 'random' AS split, unit AS condition_id, part FROM dr
      UNION ALL SELECT repeat, 'unseen_drug', condition_id, part FROM tr JOIN dc ON cluster = unit UNION ALL SELECT repeat, 'unseen_cell_line', condition_id, part FROM tr JOIN dl ON cell_line = unit
      UNION ALL SELECT dl.repeat, 'both_unseen', condition_id, dl.part FROM tr JOIN dl ON cell_line = dl.unit JOIN dc ON cluster = dc.unit AND dc.repeat = dl.repeat WHERE dl.part = dc.part)"""


def _treated(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf).filter("not is_control").select("condition_id", "cell_line", F.col("cluster_id").alias("cluster"), "drug", "dose")


@query(f"WITH {_VIEW}, {_SPLITS} SELECT * FROM sp")
def splits(spark, sf):
    return evaluation.make_splits(_treated(spark, sf), REPEATS)


@query(f"""WITH {_VIEW}, {_SPLITS} SELECT repeat, split, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test,
    count(DISTINCT cell_line) AS n_lines, count(DISTINCT cluster) AS n_clusters FROM sp JOIN tr USING (condition_id) GROUP BY 1, 2""")
def split_sizes(spark, sf):
    t = _treated(spark, sf)
    return evaluation.split_sizes(evaluation.make_splits(t, REPEATS), t)


_Y = f"""y0 AS (SELECT condition_id, {sql_strip("gene_symbol")} AS gene_symbol, log2foldchange AS y, CASE WHEN padj IS NOT NULL AND NOT isnan(padj) THEN padj ELSE 2 END AS p FROM de_sets WHERE {_OKDE} AND NOT isinf(log2foldchange)),
    yv AS (SELECT condition_id, gene_symbol, y FROM y0 QUALIFY row_number() OVER (PARTITION BY condition_id, gene_symbol ORDER BY p, abs(y) DESC, y) = 1)"""


#: The evaluated genes: the universe, whole.
_UNIVERSE = f"""gd AS (SELECT rank AS gene, {sql_strip("gene_symbol")} AS gene_symbol FROM de_sets WHERE gene_symbol IS NOT NULL AND rank IS NOT NULL), gp AS (SELECT DISTINCT {sql_strip("gene_symbol")} AS gene_symbol FROM de_sets WHERE NOT contains(gene_symbol, '.')),
    gu AS MATERIALIZED (SELECT DISTINCT gene_symbol FROM gd SEMI JOIN gp USING (gene_symbol))"""


def _universe(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(gene_universe(spark, sf).select("gene_symbol"), "universe")


@query(f"""WITH {_VIEW}, {_UNIVERSE}, {_Y}, z AS (SELECT condition_id, y FROM yv SEMI JOIN gu USING (gene_symbol))
    SELECT condition_id, CAST((SELECT count(*) FROM gu) AS INTEGER) AS n_genes, count(y) FILTER (y <> 0) AS n_nonzero, round(coalesce(sum(CAST(CAST(y AS FLOAT) AS DOUBLE)), CAST(0 AS DOUBLE)), 6) AS total FROM (SELECT DISTINCT condition_id FROM v WHERE NOT is_control) LEFT JOIN z USING (condition_id) GROUP BY 1""")
def dense_targets(spark, sf):
    """Dense target vectors over the whole gene universe, summed up per condition."""
    genes = [r[0] for r in _universe(spark, sf).orderBy("gene_symbol").collect()]
    dense = evaluation.dense_targets(evaluation.best_values(table(spark, sf, "de_sets")), _treated(spark, sf), genes)
    total = F.aggregate("y", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return dense.select("condition_id", F.size("y").alias("n_genes"), F.size(F.filter("y", lambda v: v != 0)).cast("long").alias("n_nonzero"), F.round(total, 6).alias("total"))


# ---------------------------------------------------------------------------------------------------------------------
# Models and metrics: all genes, repeats and splits
# ---------------------------------------------------------------------------------------------------------------------

RUN = harness.RUN


#: What each split keeps together.
DEMANDS = {"unseen_drug": ["cluster"], "unseen_cell_line": ["cell_line"], "both_unseen": ["cluster", "cell_line"]}


def _runs(spark: SparkSession, sf: str, coded: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(conditions of every repeat and split, values, DE sets, genes) over the whole gene universe; conditions without drug or dose take no part. ``coded``: genes are numbers in the order of their symbols."""
    c = _conditions(spark, sf).filter("not is_control and drug is not null and dose is not null").select("condition_id", "cell_line", "drug", "dose")
    treated = materialize(_treated(spark, sf), "treated")
    assigned = contracts.write_checked(evaluation.make_splits(treated, REPEATS), scratch_path(spark, "splits"), lambda written: contracts.check_named_splits(written, treated.select("condition_id", "cluster", "cell_line"), DEMANDS))
    runs = materialize(assigned.join(c, "condition_id"), "runs")
    genes = _universe(spark, sf)
    values = evaluation.best_values(table(spark, sf, "de_sets")).join(genes, "gene_symbol", "left_semi")
    sets = evaluation.de_sets(table(spark, sf, "de_sets"), genes)
    if coded:
        genes, values, sets = harness.coded(genes, values, sets)
    return runs, materialize(values, "values"), materialize(sets, "sets"), genes


def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    """(drug, units) of all drugs with a structure text: the counted pieces by which drugs are compared."""
    texts = table(spark, sf, "shard_cells").groupBy(lower_key("drug").alias("drug")).agg(F.min("canonical_smiles").alias("text")).filter("drug is not null and text is not null")
    return materialize(features.text_units(texts, "drug", "text"), "drug-units")


def _answers(spark: SparkSession, sf: str, model: str, coded: bool = False):
    """(told, predicted, values, sets, genes) of a model for every repeat and split; ``coded``: genes as numbers, predictions packed."""
    runs, values, sets, genes = _runs(spark, sf, coded)
    told, predicted = harness.predict(model, runs, values, _similarity(spark, sf) if model == "nearest_chemical" else None, pack=coded)
    return told, predicted, values, sets, genes


_SETS_U = f"""u0 AS (SELECT condition_id, {sql_strip("gene_symbol")} AS gene_symbol, log2foldchange, padj FROM de_sets WHERE {_OKDE} AND padj IS NOT NULL AND NOT isnan(padj) AND padj < 0.05),
    u1 AS (SELECT * FROM u0 SEMI JOIN gu USING (gene_symbol) QUALIFY row_number() OVER (PARTITION BY condition_id, gene_symbol ORDER BY padj, abs(log2foldchange) DESC, log2foldchange) = 1),
    du AS MATERIALIZED (SELECT condition_id, gene_symbol, CAST(row_number() OVER (PARTITION BY condition_id ORDER BY padj, abs(log2foldchange) DESC, gene_symbol) AS INTEGER) AS rank FROM u1 QUALIFY rank <= 200)"""
_RUNS = f"""{_VIEW}, {_SPLITS}, {_UNIVERSE}, {_Y}, {_SETS_U}, yu AS MATERIALIZED (SELECT * FROM yv SEMI JOIN gu USING (gene_symbol)),
    kc AS (SELECT condition_id, {_UP("cell_line")} AS cell_line, {_KEY("drug")} AS drug, round(dose, 6) AS dose FROM conditions WHERE NOT is_control AND drug IS NOT NULL AND dose IS NOT NULL),
    rn AS MATERIALIZED (SELECT repeat, split, part, kc.* FROM sp JOIN kc USING (condition_id)), tn AS MATERIALIZED (SELECT * FROM rn WHERE part <> 'test'),
    te AS MATERIALIZED (SELECT * FROM rn SEMI JOIN tn USING (repeat, split, dose) WHERE part = 'test'),
    dn AS (SELECT repeat, split, dose, count(*) AS n FROM tn GROUP BY ALL),
    dm AS (SELECT repeat, split, dose, gene_symbol, CAST(sum(y) / any_value(n) AS FLOAT) AS p FROM tn JOIN yu USING (condition_id) JOIN dn USING (repeat, split, dose) WHERE y <> 0 GROUP BY ALL)"""


def _means_sql(key: str) -> str:
    """told (condition, its source) and pr (source, gene, prediction that is not 0) of the mean by ``key`` and dose."""
    name = f"'{key}|' || coalesce({key}, '') || '|' || CAST(dose AS VARCHAR)"
    return f"""kn AS (SELECT repeat, split, {key}, dose, count(*) AS n FROM tn WHERE {key} IS NOT NULL GROUP BY ALL),
    km AS (SELECT repeat, split, {key}, dose, gene_symbol, CAST(sum(y) / any_value(n) AS FLOAT) AS p FROM tn JOIN yu USING (condition_id) JOIN kn USING (repeat, split, {key}, dose) WHERE y <> 0 GROUP BY ALL),
    told AS MATERIALIZED (SELECT repeat, split, condition_id, cell_line, n IS NULL AS is_fallback, CASE WHEN n IS NULL THEN 'dose||' || CAST(dose AS VARCHAR) ELSE {name} END AS source FROM te LEFT JOIN kn USING (repeat, split, {key}, dose)),
    p0 AS (SELECT repeat, split, '{key}' AS kind, {key} AS name, dose, {name} AS source, gene_symbol, p FROM km UNION ALL SELECT repeat, split, 'dose', NULL, dose, 'dose||' || CAST(dose AS VARCHAR), gene_symbol, p FROM dm),
    pr AS MATERIALIZED (SELECT * FROM p0 SEMI JOIN told USING (repeat, split, source) WHERE p <> 0)"""


def _opened(predicted: DataFrame, key: str) -> DataFrame:
    """Predictions that are not 0, by what they come from: a drug or cell line at a dose, or the dose alone."""
    s = F.from_json("source", "kind string, drug string, cell_line string, dose double")
    opened = predicted.withColumn("s", s)
    return opened.select(*RUN, "s.kind", F.col(f"s.{key}").alias("name"), "s.dose", "gene_symbol", F.round(F.col("predicted").cast("double"), 5).alias("predicted"))


_OPENED = "SELECT repeat, split, kind, name, dose, gene_symbol, round(CAST(p AS DOUBLE), 5) AS predicted FROM pr"


@query(f"WITH {_RUNS}, {_means_sql('drug')} {_OPENED}")
def drug_mean(spark, sf):
    return _opened(_answers(spark, sf, "drug_mean")[1], "drug")


@query(f"WITH {_RUNS}, {_means_sql('cell_line')} {_OPENED}")
def cell_mean(spark, sf):
    return _opened(_answers(spark, sf, "cell_mean")[1], "cell_line")


@query(f"WITH {_RUNS} SELECT repeat, split, 'dose' AS kind, CAST(NULL AS VARCHAR) AS name, dose, gene_symbol, round(CAST(p AS DOUBLE), 5) AS predicted FROM dm SEMI JOIN te USING (repeat, split, dose) WHERE p <> 0")
def global_mean(spark, sf):
    return _opened(_answers(spark, sf, "global_mean")[1], "drug")


@query(f"WITH {_RUNS}, {_means_sql('drug')} SELECT repeat, split, count(*) AS n_conditions, round(avg(CAST(is_fallback AS INTEGER)), 9) AS fallback_rate FROM told GROUP BY 1, 2")
def fallback_rate(spark, sf):
    told = _answers(spark, sf, "drug_mean")[0]
    return told.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_conditions"), F.round(F.avg(F.col("is_fallback").cast("int")), 9).alias("fallback_rate"))


_QGRAMS = f"""dt AS (SELECT {_KEY("drug")} AS drug, min(canonical_smiles) AS t FROM shard_cells WHERE drug IS NOT NULL GROUP BY 1 HAVING t IS NOT NULL),
    qg AS (SELECT drug, substr(t, CAST(i AS INTEGER), k) AS gram, count(*) AS n FROM (SELECT drug, t, k, unnest(generate_series(1, length(t) - k + 1)) AS i FROM dt, (SELECT unnest([1, 2]) AS k)) GROUP BY ALL),
    qs AS (SELECT drug, sum(n) AS total FROM qg GROUP BY 1), ql AS (SELECT a.drug, b.drug AS other, sum(least(a.n, b.n)) AS lo FROM qg a JOIN qg b USING (gram) GROUP BY ALL),
    si AS MATERIALIZED (SELECT ql.drug, other, CAST(lo AS DOUBLE) / CAST(x.total + y.total - lo AS DOUBLE) AS similarity FROM ql JOIN qs x ON x.drug = ql.drug JOIN qs y ON y.drug = ql.other)"""


_TRIPLE = "repeat, split, cell_line, drug, dose"


def _closest_sql(name: str, asked: str, at: str, sizes: str) -> str:
    """The most similar training drugs of every asked (line, drug, dose), ties together."""
    on = " AND ".join(f"t.{c} = w.{c}" for c in ("repeat", "split", *at.split(", ")))
    return f"""{name} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {_TRIPLE}) AS tied FROM (SELECT w.*, t.other, t.n, similarity FROM {asked} w JOIN {sizes} t ON {on} JOIN si ON si.drug = w.drug AND si.other = t.other)
      QUALIFY similarity = max(similarity) OVER (PARTITION BY {_TRIPLE}))"""


@query(f"""WITH {_RUNS}, {_QGRAMS}, wn AS (SELECT DISTINCT {_TRIPLE} FROM te), ln AS (SELECT repeat, split, cell_line, dose, drug AS other, count(*) AS n FROM tn GROUP BY ALL), an AS (SELECT repeat, split, dose, drug AS other, count(*) AS n FROM tn GROUP BY ALL),
    {_closest_sql("m1", "wn", "cell_line, dose", "ln")}, n1 AS (SELECT * REPLACE (count(*) OVER (PARTITION BY {_TRIPLE}) AS tied) FROM m1), wr AS (SELECT * FROM wn ANTI JOIN n1 USING ({_TRIPLE})), {_closest_sql("m2", "wr", "dose", "an")}, n2 AS (SELECT * REPLACE (count(*) OVER (PARTITION BY {_TRIPLE}) AS tied) FROM m2),
    lm AS (SELECT repeat, split, cell_line, dose, drug AS other, gene_symbol, sum(y) AS s FROM tn JOIN yu USING (condition_id) WHERE y <> 0 GROUP BY ALL), am AS (SELECT repeat, split, dose, drug AS other, gene_symbol, sum(y) AS s FROM tn JOIN yu USING (condition_id) WHERE y <> 0 GROUP BY ALL),
    f AS (SELECT {_TRIPLE}, 'line' AS kind, gene_symbol, CAST(sum(s / n) / any_value(tied) AS FLOAT) AS p FROM n1 JOIN lm USING (repeat, split, cell_line, dose, other) GROUP BY ALL
      UNION ALL SELECT {_TRIPLE}, 'dose', gene_symbol, CAST(sum(s / n) / any_value(tied) AS FLOAT) FROM n2 JOIN am USING (repeat, split, dose, other) GROUP BY ALL)
    SELECT repeat, split, kind, cell_line, drug, dose, gene_symbol, round(CAST(p AS DOUBLE), 5) AS predicted FROM f WHERE p <> 0""")
def nearest_chemical(spark, sf):
    s = F.from_json("source", "kind string, cell_line string, drug string, dose double")
    opened = _answers(spark, sf, "nearest_chemical")[1].withColumn("s", s)
    return opened.select(*RUN, "s.kind", "s.cell_line", "s.drug", "s.dose", "gene_symbol", F.round(F.col("predicted").cast("double"), 5).alias("predicted"))


SLOTS, BUCKETS = 24, 16


def _design(spark: SparkSession, sf: str) -> DataFrame:
    """(condition_id, x): log1p counts of the pieces of the drug's structure text in ``SLOTS`` slots, log10 of the dose, and log1p CPM of the line's vehicle cells in ``BUCKETS`` buckets of genes.

    Conditions of a drug without a text, of a line without vehicle cells, or without a positive dose have no features."""
    cells = table(spark, sf, "shard_cells")
    texts = cells.filter("canonical_smiles <> ''").groupBy(lower_key("drug").alias("drug")).agg(F.min("canonical_smiles").alias("text"))
    pieces = texts.select("drug", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"), "text").select("drug", F.pmod(F.xxhash64(F.substring(F.col("text"), F.col("i"), F.lit(2))), F.lit(SLOTS)).alias("slot"))
    prints = pieces.groupBy("drug").agg(F.array(*[F.count_if(F.col("slot") == j) for j in range(SLOTS)]).alias("counts"))
    vehicle = cells.filter(S.is_control("drug")).select(upper_key("cell_line").alias("cell_line"), F.inline(F.arrays_zip(F.col("genes").alias("gene"), F.col("expressions").alias("amount")))).filter("gene is not null and amount is not null and gene <> 1")
    bucket = F.pmod(F.xxhash64("gene"), F.lit(BUCKETS))
    sums = vehicle.groupBy("cell_line").agg(F.sum("amount").alias("all"), *[F.sum(F.when(bucket == j, F.col("amount")).otherwise(0.0)).alias(f"b{j}") for j in range(BUCKETS)])
    lines = sums.filter("all > 0").select("cell_line", *[F.log1p(F.col(f"b{j}") / F.col("all") * 1e6).alias(f"b{j}") for j in range(BUCKETS)])
    c = _conditions(spark, sf).filter("not is_control and dose > 0").join(prints, "drug").join(lines, "cell_line")
    return c.select("condition_id", ridge.design(F.col("counts"), [F.log10("dose"), *[F.col(f"b{j}") for j in range(BUCKETS)]]).alias("x"))


def _ridge(spark: SparkSession, sf: str):
    runs, values, sets, _ = _runs(spark, sf)
    x = materialize(_design(spark, sf), "design")
    fitted, chosen = ridge.train(runs, x, values, sets)
    return runs, values, sets, x, fitted, chosen


@query()
def ridge_penalties(spark, sf):
    """The penalty of every repeat and split, by the validation rows' median correlation."""
    return _ridge(spark, sf)[-1]


@query()
def ridge_scores(spark, sf):
    """Ridge scored over the DE genes of every test condition with features, of all repeats and splits."""
    runs, values, sets, x, fitted, chosen = _ridge(spark, sf)
    told = runs.filter("part = 'test'").join(x.select("condition_id"), "condition_id", "left_semi").select(*RUN, "condition_id", F.col("condition_id").alias("source"))
    asked = told.select(*RUN, "condition_id").join(sets.select("condition_id", "gene_symbol"), "condition_id")
    predicted = ridge.predict(fitted, chosen, asked, runs, x).withColumnRenamed("condition_id", "source")
    return harness.set_scores(told, predicted, values, sets)


_SCORED = f"""{_RUNS}, {_means_sql('drug')},
    tv AS MATERIALIZED (SELECT coalesce(yu.condition_id, du.condition_id) AS condition_id, coalesce(yu.gene_symbol, du.gene_symbol) AS gene_symbol, coalesce(y, CAST(0 AS DOUBLE)) AS y, rank FROM yu FULL OUTER JOIN du ON yu.condition_id = du.condition_id AND yu.gene_symbol = du.gene_symbol),
    rw AS MATERIALIZED (SELECT told.repeat, told.split, told.condition_id, told.cell_line, told.source, tv.gene_symbol, y, rank, coalesce(CAST(p AS DOUBLE), CAST(0 AS DOUBLE)) AS x
      FROM told JOIN tv USING (condition_id) LEFT JOIN pr ON pr.repeat = told.repeat AND pr.split = told.split AND pr.source = told.source AND pr.gene_symbol = tv.gene_symbol)"""
_CORR = "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE CAST(0 AS DOUBLE) END"
_G = "(SELECT count(*) FROM gu)"
_CENTRED = lambda q, t, n: f"CASE WHEN {q} - {t} * {t} / {n} > {q} * 1e-12 THEN {q} - {t} * {t} / {n} ELSE 0 END"


@query(f"""WITH {_SCORED}, m AS (SELECT repeat, split, condition_id, count(*) AS n, round(CASE WHEN count(*) > 1 THEN {_CORR} END, 5) AS de_pearson, round(avg((x - y) * (x - y)) + 1e-11, 8) AS de_mse,
      round(avg(CASE WHEN sign(x) = sign(y) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS sign_accuracy FROM rw WHERE rank IS NOT NULL GROUP BY ALL)
    SELECT repeat, split, condition_id, CAST(coalesce(n, 0) AS INTEGER) AS n_de_genes, de_pearson, de_mse, sign_accuracy FROM told LEFT JOIN m USING (repeat, split, condition_id)""")
def mse_sign(spark, sf):
    """drug_mean scored over the DE genes of every test condition of all repeats and splits."""
    told, predicted, values, sets, _ = _answers(spark, sf, "drug_mean")
    m = harness.set_scores(told, predicted, values, sets)
    return m.select(*RUN, "condition_id", "n_de_genes", F.round("de_pearson", 5).alias("de_pearson"), F.round(F.col("de_mse") + 1e-11, 8).alias("de_mse"), F.round("sign_accuracy", 9).alias("sign_accuracy"))


def _scored(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return harness.score(*_answers(spark, sf, "drug_mean", coded=True), places=7).select(*RUN, "condition_id", *columns)


@query(f"""WITH {_SCORED}, a AS (SELECT repeat, split, condition_id, sum(x * y) AS py, sum(y) AS ty, sum(y * y) AS tyy FROM rw GROUP BY ALL), b AS (SELECT repeat, split, source, sum(CAST(p AS DOUBLE)) AS tp, sum(CAST(p AS DOUBLE) * p) AS tpp FROM pr GROUP BY ALL),
    t AS (SELECT repeat, split, condition_id, coalesce(py, 0) AS py, coalesce(ty, 0) AS ty, coalesce(tyy, 0) AS tyy, coalesce(tp, 0) AS tp, coalesce(tpp, 0) AS tpp, CAST({_G} AS DOUBLE) AS g FROM told LEFT JOIN a USING (repeat, split, condition_id) LEFT JOIN b USING (repeat, split, source)),
    c AS (SELECT *, py - tp * ty / g AS cov, {_CENTRED("tpp", "tp", "g")} AS va, {_CENTRED("tyy", "ty", "g")} AS vb FROM t)
    SELECT repeat, split, condition_id, round(CASE WHEN va > 0 AND vb > 0 THEN cov / sqrt(va * vb) ELSE CAST(0 AS DOUBLE) END, 5) AS all_gene_pearson FROM c""")
def pearson_by_group(spark, sf):
    return _scored(spark, sf, F.round("all_gene_pearson", 5).alias("all_gene_pearson"))


_OVERLAP = lambda k: f"""CASE WHEN n_de = 0 THEN NULL WHEN spread = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(both_{k} AS DOUBLE) / (2 * least(n_de, {k}) - both_{k}), 9) END AS topk_overlap_{k}"""


@query(f"""WITH {_SCORED}, sr AS (SELECT DISTINCT repeat, split, source FROM told), full_p AS (SELECT sr.*, gu.gene_symbol, coalesce(abs(CAST(p AS DOUBLE)), 0) AS size FROM sr CROSS JOIN gu LEFT JOIN pr USING (repeat, split, source, gene_symbol)),
    nt AS (SELECT *, row_number() OVER (PARTITION BY repeat, split, source ORDER BY size DESC, gene_symbol) AS nth FROM full_p), top AS (SELECT * FROM nt WHERE nth <= 100), sd AS (SELECT repeat, split, source, max(size) - min(size) AS spread FROM full_p GROUP BY ALL),
    nd AS (SELECT condition_id, count(*) AS n_de FROM du GROUP BY 1), bo AS (SELECT told.repeat, told.split, told.condition_id, count(*) FILTER (greatest(rank, nth) <= least(n_de, 50)) AS both_50, count(*) FILTER (greatest(rank, nth) <= least(n_de, 100)) AS both_100
      FROM told JOIN nd USING (condition_id) JOIN du USING (condition_id) JOIN top ON top.repeat = told.repeat AND top.split = told.split AND top.source = told.source AND top.gene_symbol = du.gene_symbol GROUP BY ALL),
    j AS (SELECT repeat, split, condition_id, coalesce(n_de, 0) AS n_de, spread, coalesce(both_50, 0) AS both_50, coalesce(both_100, 0) AS both_100 FROM told JOIN sd USING (repeat, split, source) LEFT JOIN nd USING (condition_id) LEFT JOIN bo USING (repeat, split, condition_id))
    SELECT repeat, split, condition_id, {_OVERLAP(50)}, {_OVERLAP(100)} FROM j""")
def topk_overlap(spark, sf):
    """The SQL ranks all genes of the universe for every prediction, zeros among them; the query needs only those that are not 0."""
    return _scored(spark, sf, *[F.round(f"topk_overlap_{k}", 9).alias(f"topk_overlap_{k}") for k in (50, 100)])


def _disc_sql(name: str, line: str) -> str:
    return f"""{name} AS (SELECT o.repeat, o.split, o.q AS condition_id, count(*) FILTER (c <> o.q AND r > own) AS closer, count(*) FILTER (c <> o.q AND r = own) AS ties, count(*) - 1 AS n
      FROM (SELECT told.repeat, told.split, told.condition_id AS q, told.cell_line, told.source, r AS own FROM told JOIN rr ON rr.repeat = told.repeat AND rr.split = told.split AND rr.source = told.source AND rr.c = told.condition_id) o
      JOIN rr ON rr.repeat = o.repeat AND rr.split = o.split AND rr.source = o.source {line} GROUP BY ALL)"""


_DISC = lambda t, n: f"""round(CASE WHEN {t}.n > 0 THEN ({t}.closer + {t}.ties * 0.5::DOUBLE) / {t}.n END, 9) AS disc_rank_{n}, CASE WHEN {t}.n > 0 THEN CASE WHEN {t}.closer = 0 AND {t}.ties = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END END AS disc_top1_{n}"""


@query(f"""WITH {_SCORED}, un AS MATERIALIZED (SELECT DISTINCT repeat, split, gene_symbol FROM rw WHERE rank IS NOT NULL), us AS (SELECT repeat, split, CAST(count(*) AS DOUBLE) AS g FROM un GROUP BY 1, 2),
    pp AS MATERIALIZED (SELECT repeat, split, source, gene_symbol, CAST(p AS DOUBLE) AS p FROM pr SEMI JOIN un USING (repeat, split, gene_symbol)), tt AS MATERIALIZED (SELECT repeat, split, condition_id, gene_symbol, y FROM rw SEMI JOIN un USING (repeat, split, gene_symbol) WHERE y <> 0),
    ps AS (SELECT repeat, split, source, sum(p) AS tp, sum(p * p) AS tpp FROM pp GROUP BY ALL), ts AS (SELECT repeat, split, condition_id, sum(y) AS ty, sum(y * y) AS tyy FROM tt GROUP BY ALL),
    dt AS (SELECT repeat, split, source, condition_id AS c, sum(p * y) AS d FROM pp JOIN tt USING (repeat, split, gene_symbol) GROUP BY ALL), sr AS (SELECT DISTINCT repeat, split, source FROM told),
    pa AS (SELECT repeat, split, source, t.condition_id AS c, t.cell_line, coalesce(tp, 0) AS tp, coalesce(tpp, 0) AS tpp, coalesce(ty, 0) AS ty, coalesce(tyy, 0) AS tyy, coalesce(d, 0) AS d, coalesce(g, 1) AS g
      FROM sr JOIN (SELECT repeat, split, condition_id, cell_line FROM told) t USING (repeat, split) LEFT JOIN ps USING (repeat, split, source) LEFT JOIN ts USING (repeat, split, condition_id) LEFT JOIN us USING (repeat, split)
      LEFT JOIN dt ON dt.repeat = sr.repeat AND dt.split = sr.split AND dt.source = sr.source AND dt.c = t.condition_id),
    va AS (SELECT *, d - tp * ty / g AS cov, {_CENTRED("tpp", "tp", "g")} AS a, {_CENTRED("tyy", "ty", "g")} AS b FROM pa),
    rr AS MATERIALIZED (SELECT repeat, split, source, c, cell_line, round(CASE WHEN a > 0 AND b > 0 THEN cov / sqrt(a * b) ELSE 0 END, 7) + 0.0 AS r FROM va), {_disc_sql("qa", "")}, {_disc_sql("qb", "AND rr.cell_line IS NOT DISTINCT FROM o.cell_line")}
    SELECT qa.repeat, qa.split, qa.condition_id, {_DISC("qa", "global")}, {_DISC("qb", "within_line")} FROM qa JOIN qb USING (repeat, split, condition_id)""")
def discrimination_rank(spark, sf):
    """Global and within the cell line, over the union of the DE genes of a run's test conditions."""
    return _scored(spark, sf, *[(F.round(c, 9) if "rank" in c else F.col(c)).alias(c) for c in ("disc_rank_global", "disc_top1_global", "disc_rank_within_line", "disc_top1_within_line")])


@query(f"""WITH {_SCORED}, d AS (SELECT repeat, split, condition_id, sqrt(sum(power(x - y, 2))) AS d FROM rw WHERE rank IS NOT NULL GROUP BY ALL)
    SELECT repeat, split, condition_id, round(coalesce(d, -1), 5) AS distance FROM told LEFT JOIN d USING (repeat, split, condition_id) QUALIFY row_number() OVER (PARTITION BY repeat, split ORDER BY round(coalesce(d, -1), 7) DESC, condition_id) = 1""")
def farthest_condition(spark, sf):
    """Of every repeat and split the test condition whose truth lies farthest from the prediction over its DE genes; without DE genes the distance is -1."""
    told, predicted, values, sets, _ = _answers(spark, sf, "drug_mean")
    d = harness.set_scores(told, predicted, values, sets).withColumn("d", F.round(F.coalesce("de_distance", F.lit(-1.0)), 7))
    first = F.min(F.struct((-F.col("d")).alias("less"), "condition_id"))
    return d.groupBy(*RUN).agg(first.alias("f")).select(*RUN, "f.condition_id", F.round(-F.col("f.less"), 5).alias("distance"))


@query()
def harness_scores(spark, sf):
    """Every model's scores for every test condition of all repeats and splits, from one assembly of the evaluation data."""
    runs, values, sets, genes = _runs(spark, sf, coded=True)
    told = predicted = None
    for model in harness.MODELS:
        one = [x.withColumn("model", F.lit(model)) for x in harness.predict(model, runs, values, _similarity(spark, sf) if model == "nearest_chemical" else None, pack=True)]
        told, predicted = one if told is None else (told.unionByName(one[0]), predicted.unionByName(one[1]))
    return harness.score(told, predicted, values, sets, genes)


def _harness(model: str):
    def scores(spark, sf):
        return harness.score(*_answers(spark, sf, model, coded=True))

    scores.__name__ = f"harness_{model}"
    scores.__doc__ = f"Scores of {model} for the test conditions of every repeat and split, over all genes."
    return scores


for _model in harness.MODELS:
    query()(_harness(_model))


# ---------------------------------------------------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------------------------------------------------

_SPLIT = f"replace({_KEY('split')}, '-', '_')"
_SC = f"sc AS (SELECT repeat, {_SPLIT} AS split, condition_id, model, CASE WHEN NOT isnan(de_pearson) AND NOT isinf(de_pearson) THEN de_pearson END AS v FROM per_condition WHERE split IS NOT NULL AND repeat IS NOT NULL)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "per_condition").filter("split is not null and repeat is not null").withColumn("split", split_key("split"))


@query(f"""WITH {_SC}, m AS (SELECT split, repeat, median(v) AS m FROM sc GROUP BY 1, 2) SELECT split, round(quantile_cont(v, 0.25), 6) AS iqr_low, round(quantile_cont(v, 0.75), 6) AS iqr_high, count(v) AS n_scored, count(*) - count(v) AS n_nan, any_value(e) AS estimate
    FROM sc JOIN (SELECT split, round(avg(m), 6) AS e FROM m GROUP BY 1) USING (split) GROUP BY 1""")
def score_summary(spark, sf):
    return stats.score_summary(_scores(spark, sf), "de_pearson")


@query(f"""WITH {_SC}, m AS (SELECT split, repeat, model, median(v) AS m FROM sc GROUP BY ALL) PIVOT (SELECT model, split, round(avg(m), 5) AS e FROM m GROUP BY ALL) ON split IN ('random', 'unseen_drug', 'unseen_cell_line', 'both_unseen') USING first(e) GROUP BY model""")
def model_table(spark, sf):
    per = stats.medians(_scores(spark, sf), ["model", "split", "repeat"], "de_pearson").groupBy("model", "split").agg(F.round(F.avg("m"), 5).alias("e"))
    return per.groupBy("model").pivot("split", ["random", "unseen_drug", "unseen_cell_line", "both_unseen"]).agg(F.first("e"))


@query(f"""WITH {_SC} SELECT condition_id, count(v) AS n_scores, round(avg(v), 6) AS mean_score FROM sc WHERE v IS NOT NULL GROUP BY 1 ORDER BY round(avg(v), 6), condition_id LIMIT 20""")
def worst_conditions(spark, sf):
    """The 20 conditions that all models together predict worst."""
    v = _scores(spark, sf).filter(S.finite("de_pearson"))
    return v.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_scores"), F.round(F.avg("de_pearson"), 6).alias("mean_score")).orderBy("mean_score", "condition_id").limit(20)


@query()
def report_table(spark, sf):
    """Model x split table of estimates with their intervals and the share of conditions scored; ``n.d.`` where a model has no score."""
    scores = _scores(spark, sf)
    covered = scores.groupBy("model", "split").agg(F.avg(S.finite("de_pearson").cast("double")).alias("coverage"))
    intervals = stats.bootstrap_intervals(scores, ["model", "split"], "de_pearson")
    return stats.model_table(intervals.join(covered, ["model", "split"]), ["random", "unseen_drug", "unseen_cell_line", "both_unseen"])


@query()
def bootstrap_ci(spark, sf):
    return stats.bootstrap_intervals(_scores(spark, sf), ["model", "split"], "de_pearson")


@query(f"""WITH {_SC}, a AS (SELECT repeat, split, condition_id, min(v) AS a FROM sc WHERE model = 'neural' AND v IS NOT NULL GROUP BY ALL), b AS (SELECT repeat, split, condition_id, min(v) AS b FROM sc WHERE model = 'ridge' AND v IS NOT NULL GROUP BY ALL)
    SELECT repeat, split, condition_id, a - b AS difference FROM a JOIN b USING (repeat, split, condition_id)""")
def paired_diff(spark, sf):
    return stats.paired_differences(_scores(spark, sf), "neural", "ridge", "de_pearson")


@query()
def paired_ci(spark, sf):
    return stats.with_no_difference(stats.bootstrap_intervals(stats.paired_differences(_scores(spark, sf), "neural", "ridge", "de_pearson"), ["split"], "difference"))


@query(f"""WITH {_SC}, m AS (SELECT split, repeat, median(v) AS m FROM sc GROUP BY 1, 2), a AS (SELECT split, m AS g FROM m WHERE repeat = 0), b AS (SELECT split, m AS w FROM m WHERE repeat = 1)
    SELECT coalesce(a.split, b.split) AS split, g AS got, w AS want, CASE WHEN a.split IS NULL THEN 'missing' WHEN b.split IS NULL THEN 'unexpected' WHEN (g IS NULL) <> (w IS NULL) THEN 'null' ELSE 'differs' END AS reason
    FROM a FULL OUTER JOIN b ON a.split = b.split WHERE a.split IS NULL OR b.split IS NULL OR (g IS NULL) <> (w IS NULL) OR abs(g - w) > 0.003""")
def tolerance_compare(spark, sf):
    """Medians of repeat 0 against those of repeat 1."""
    m = stats.medians(_scores(spark, sf), ["split", "repeat"], "de_pearson")
    return exports.compare_with_tolerance(m.filter("repeat = 0"), m.filter("repeat = 1"), ["split"], "m", 0.003)


@query()
def summary_documents(spark, sf):
    return stats.summary_documents(_scores(spark, sf), ["de_pearson", "sign_accuracy"])


@query(f"""WITH sv AS (SELECT repeat, {_SPLIT} AS split, model, CASE WHEN NOT isnan(de_pearson) AND NOT isinf(de_pearson) THEN de_pearson END AS v, CASE WHEN NOT isnan(de_mse) AND NOT isinf(de_mse) THEN de_mse END AS w FROM per_condition WHERE split IS NOT NULL AND repeat IS NOT NULL),
    m AS (SELECT model, split, repeat, median(v) AS v, median(w) AS w FROM sv GROUP BY ALL), e AS (SELECT model, split, round(avg(v), 5) AS v, round(avg(w), 5) AS w FROM m GROUP BY ALL)
    SELECT a.split, a.v AS neural, b.v AS ridge, a.w AS neural_mse, b.w AS ridge_mse, CASE WHEN a.v - b.v > 0 AND a.w - b.w < 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS verdict FROM e a JOIN e b ON a.split = b.split WHERE a.model = 'neural' AND b.model = 'ridge'""")
def verdicts(spark, sf):
    """Whether one model's median correlation is above and its median error below another's, per split, without an interval; claim_verdicts has the reference's rule."""
    scores = _scores(spark, sf)
    keys = ["model", "split", "repeat"]
    both = stats.medians(scores, keys, "de_pearson", "v").join(stats.medians(scores, keys, "de_mse", "w"), keys).groupBy("model", "split").agg(F.round(F.avg("v"), 5).alias("v"), F.round(F.avg("w"), 5).alias("w"))
    one = lambda m: both.filter(F.col("model") == m).select("split", F.col("v").alias(m), F.col("w").alias(f"{m}_mse"))
    paired = one("neural").join(one("ridge"), "split").withColumns({"gain": F.col("neural") - F.col("ridge"), "loss": F.col("neural_mse") - F.col("ridge_mse")})
    return paired.select("split", "neural", "ridge", "neural_mse", "ridge_mse", stats.verdict("gain", "loss").alias("verdict"))


@query()
def claim_verdicts(spark, sf):
    """Whether neural beats ridge, per split: the paired interval of de_pearson lies above 0 and the paired de_mse is lower.

    per_condition has no discrimination rank, so de_mse is the second metric, lower being better as well."""
    scores = _scores(spark, sf)
    paired = lambda metric: stats.bootstrap_intervals(stats.paired_differences(scores, "neural", "ridge", metric), ["split"], "difference")
    de = paired("de_pearson").select("split", F.col("estimate").alias("de_pearson"), F.col("ci_low").alias("de_low"), F.col("ci_high").alias("de_high"))
    both = de.join(paired("de_mse").select("split", F.col("estimate").alias("de_mse"), F.col("ci_low").alias("mse_low"), F.col("ci_high").alias("mse_high")), "split", "left")
    return both.withColumn("verdict", stats.verdict("de_low", "de_mse"))


# ---------------------------------------------------------------------------------------------------------------------
# Cross-check, lookup
# ---------------------------------------------------------------------------------------------------------------------

_CMP = f"""{_Y}, kd AS (SELECT condition_id, {_KEY("drug")} AS drug FROM conditions WHERE drug IS NOT NULL), om AS (SELECT drug, gene_symbol, avg(y) AS m FROM yv JOIN kd USING (condition_id) GROUP BY 1, 2),
    ou AS (SELECT condition_id, gene_symbol, round(m, 9) AS logfc FROM kd JOIN om USING (drug)),
    th AS (SELECT condition_id, {sql_strip("gene_symbol")} AS gene_symbol, log2foldchange FROM de_sets WHERE {_OKDE} AND NOT isinf(log2foldchange) AND padj IS NOT NULL AND NOT isnan(padj) AND padj < 0.05),
    tw AS (SELECT *, count(*) OVER (PARTITION BY condition_id, gene_symbol) AS nt FROM th), cl AS (SELECT condition_id, log2foldchange AS b, logfc AS a FROM tw JOIN ou USING (condition_id, gene_symbol) WHERE nt = 1),
    rk AS (SELECT condition_id, a, b, rank() OVER (PARTITION BY condition_id ORDER BY a) + (count(*) OVER (PARTITION BY condition_id, a) - 1) / 2::DOUBLE AS x, rank() OVER (PARTITION BY condition_id ORDER BY b) + (count(*) OVER (PARTITION BY condition_id, b) - 1) / 2::DOUBLE AS y FROM cl),
    sr AS (SELECT condition_id, count(*) AS n_compared, round(avg(CASE WHEN sign(a) = sign(b) THEN 1::DOUBLE ELSE 0::DOUBLE END), 9) AS sign_agreement, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN {_CORR} END, 6) AS spearman FROM rk GROUP BY 1),
    cp AS (SELECT condition_id, coalesce(n_compared, 0) AS n_compared, n_ambiguous, sign_agreement, spearman FROM (SELECT condition_id, count(DISTINCT CASE WHEN nt > 1 THEN gene_symbol END) AS n_ambiguous FROM tw GROUP BY 1) LEFT JOIN sr USING (condition_id))"""


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    """Each condition's significant changes against the mean change of its drug over all conditions."""
    de = table(spark, sf, "de_sets")
    drugs = _conditions(spark, sf).filter("drug is not null").select("condition_id", "drug")
    mean = evaluation.best_values(de).join(drugs, "condition_id").groupBy("drug", "gene_symbol").agg(F.round(F.avg("y"), 9).alias("logfc"))
    theirs = de.filter("gene_symbol is not null").withColumn("gene_symbol", strip_blanks("gene_symbol"))
    wanted = evaluation.significant(de).select("condition_id", "gene_symbol").distinct().join(drugs, "condition_id")
    ours = wanted.join(mean, ["drug", "gene_symbol"]).select("condition_id", "gene_symbol", "logfc")
    return crosscheck.compare(ours, theirs)


@query(f"WITH {_CMP} SELECT * FROM cp")
def de_crosscheck(spark, sf):
    return _compared(spark, sf).withColumn("spearman", F.round("spearman", 6))


@query(f"""WITH {_CMP} SELECT count(sign_agreement) AS n_conditions, round(min(sign_agreement), 6) AS sign_min, round(quantile_cont(sign_agreement, 0.25), 6) AS sign_p25, round(median(sign_agreement), 6) AS sign_median,
    round(quantile_cont(sign_agreement, 0.75), 6) AS sign_p75, round(max(sign_agreement), 6) AS sign_max, round(median(spearman), 4) AS spearman_median, CASE WHEN round(median(sign_agreement), 6) >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM cp""")
def crosscheck_distribution(spark, sf):
    return crosscheck.distribution(_compared(spark, sf), 0.9).withColumn("spearman_median", F.round("spearman_median", 4))


_OWN = f"""{_LOGFC}, gd AS (SELECT rank AS gene, {sql_strip("gene_symbol")} AS gene_symbol FROM de_sets WHERE gene_symbol IS NOT NULL AND rank IS NOT NULL), dy AS (SELECT gene_symbol, min(gene) AS gene FROM gd GROUP BY 1),
    sm AS (SELECT condition_id FROM (SELECT DISTINCT condition_id FROM lf) ORDER BY md5('20260926|' || condition_id), condition_id LIMIT 200),
    ou AS (SELECT condition_id, gene_symbol, logfc FROM lf SEMI JOIN sm USING (condition_id) JOIN dy USING (gene)),
    th AS (SELECT condition_id, {sql_strip("gene_symbol")} AS gene_symbol, log2foldchange FROM de_sets SEMI JOIN sm USING (condition_id) WHERE {_OKDE} AND NOT isinf(log2foldchange) AND padj IS NOT NULL AND NOT isnan(padj) AND padj < 0.05),
    tw AS (SELECT *, count(*) OVER (PARTITION BY condition_id, gene_symbol) AS nt FROM th), cl AS (SELECT condition_id, log2foldchange AS b, logfc AS a FROM tw JOIN ou USING (condition_id, gene_symbol) WHERE nt = 1),
    rk AS (SELECT condition_id, a, b, rank() OVER (PARTITION BY condition_id ORDER BY a) + (count(*) OVER (PARTITION BY condition_id, a) - 1) / 2::DOUBLE AS x, rank() OVER (PARTITION BY condition_id ORDER BY b) + (count(*) OVER (PARTITION BY condition_id, b) - 1) / 2::DOUBLE AS y FROM cl),
    sr AS (SELECT condition_id, count(*) AS n_compared, round(avg(CASE WHEN sign(a) = sign(b) THEN 1::DOUBLE ELSE 0::DOUBLE END), 9) AS sign_agreement, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN {_CORR} END, 6) AS spearman FROM rk GROUP BY 1),
    cp AS (SELECT condition_id, coalesce(n_compared, 0) AS n_compared, coalesce(n_ambiguous, 0) AS n_ambiguous, sign_agreement, spearman FROM sm LEFT JOIN (SELECT condition_id, count(DISTINCT CASE WHEN nt > 1 THEN gene_symbol END) AS n_ambiguous FROM tw GROUP BY 1) USING (condition_id) LEFT JOIN sr USING (condition_id))"""


def _own_compared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(comparison per sampled condition, checked conditions): up to 200 conditions with own fold-changes against the delivered significant changes; one without a counterpart is listed with 0.

    The tables hold no gene dictionary; the smallest rank delivered with a symbol stands for its gene number."""
    changes, checked = _changes(spark, sf)
    changes = materialize(changes.withColumn("logfc", F.round(F.col("logfc").cast("double"), 4)), "own-changes")
    sample = materialize(crosscheck.sample_conditions(changes.select("condition_id"), 200, "20260926"), "sample")
    de = table(spark, sf, "de_sets").filter("gene_symbol is not null").withColumn("gene_symbol", strip_blanks("gene_symbol"))
    dictionary = de.filter("rank is not null").groupBy("gene_symbol").agg(F.min("rank").alias("gene"))
    theirs = de.join(sample, "condition_id", "left_semi")
    compared = crosscheck.compare(crosscheck.own_changes(changes, dictionary, sample), theirs)
    zero = F.lit(0).cast("long")
    every = sample.join(compared, "condition_id", "left").select("condition_id", F.coalesce("n_compared", zero).alias("n_compared"), F.coalesce("n_ambiguous", zero).alias("n_ambiguous"), "sign_agreement", "spearman")
    return every, checked


@query(f"{_OWN} SELECT * FROM cp")
def own_crosscheck(spark, sf):
    """The own fold-changes against the delivered table, per sampled condition."""
    return _own_compared(spark, sf)[0].withColumn("spearman", F.round("spearman", 6))


@query(f"""{_OWN}, eq AS (SELECT count(*) AS n_sampled, count(*) FILTER (n_compared > 0) AS n_matched, count(*) FILTER (cq.n_cells = k.n_cells) AS n_equal_cells FROM cp JOIN cq USING (condition_id) LEFT JOIN conditions k USING (condition_id))
    SELECT n_sampled, n_matched, n_equal_cells, round(min(sign_agreement), 6) AS sign_min, round(median(sign_agreement), 6) AS sign_median, round(max(sign_agreement), 6) AS sign_max, round(median(spearman), 4) AS spearman_median,
      CASE WHEN round(median(sign_agreement), 6) >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM cp, eq GROUP BY ALL""")
def own_crosscheck_report(spark, sf):
    """One row: conditions sampled, with genes in common, with the same number of cells on both sides, and the distribution of agreement."""
    compared, checked = _own_compared(spark, sf)
    theirs = table(spark, sf, "conditions").select("condition_id", F.col("n_cells").alias("their_cells"))
    n = compared.join(checked.select("condition_id", "n_cells"), "condition_id").join(theirs, "condition_id", "left")
    n = n.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(F.col("n_compared") > 0).alias("n_matched"), F.count_if(F.col("n_cells") == F.col("their_cells")).alias("n_equal_cells"))
    d = crosscheck.distribution(compared, 0.9).select("sign_min", "sign_median", "sign_max", F.round("spearman_median", 4).alias("spearman_median"), "status")
    return n.join(d)  # one row each


@query(f"""WITH {_W}, uo AS (SELECT condition_id, cell_line, plate, {_KEY("drug_name")} AS drug, dose * CASE unit WHEN 'nM' THEN 0.001::DOUBLE WHEN 'mM' THEN 1000::DOUBLE ELSE 1 END AS d FROM cond),
    ut AS (SELECT DISTINCT condition_id AS other_id, {_UP("cell_line")} AS cell_line, {sql_plate("plate")} AS plate, {_KEY("drug_name")} AS drug, CASE WHEN unit IS NOT NULL THEN dose * CASE unit WHEN 'nM' THEN 0.001::DOUBLE WHEN 'mM' THEN 1000::DOUBLE ELSE 1 END END AS d FROM conditions),
    mt AS (SELECT condition_id, count(*) AS n, min(other_id) AS o FROM uo JOIN ut USING (cell_line, plate, drug) WHERE abs(uo.d - ut.d) <= 1e-6 * abs(ut.d) GROUP BY 1)
    SELECT condition_id, CASE WHEN n = 1 THEN o END AS other_id, coalesce(n, 0) AS n_matches FROM (SELECT DISTINCT condition_id FROM cond) LEFT JOIN mt USING (condition_id)""")
def condition_match(spark, sf):
    """Conditions of the wells against the delivered ones, by line, plate, drug and dose in micromolar."""
    own = C.condition_table(table(spark, sf, "wells")).select("condition_id", "cell_line", "plate", lower_key("drug_name").alias("drug"), "dose", "unit")
    t = table(spark, sf, "conditions").select(F.col("condition_id").alias("other_id"), upper_key("cell_line").alias("cell_line"), plate_key("plate").alias("plate"), lower_key("drug_name").alias("drug"), "dose", "unit")
    return crosscheck.match_slices(own, t)


@query("""SELECT replace(lower(trim(split, ' ')), '-', '_') AS split, condition_id, min(repeat) AS first_repeat FROM splits WHERE split IS NOT NULL AND part = 'test' GROUP BY 1, 2""".replace("lower(trim(split, ' '))", _KEY("split")))
def first_test_repeat(spark, sf):
    """The first repeat in which a condition is tested, per split."""
    s = table(spark, sf, "splits").filter("split is not null and part = 'test'")
    return s.groupBy(split_key("split").alias("split"), "condition_id").agg(F.min("repeat").alias("first_repeat"))


@query("SELECT condition_id FROM conditions WHERE NOT is_control AND qc_pass ORDER BY md5('20260926|' || condition_id), condition_id LIMIT 200")
def sample_conditions(spark, sf):
    return crosscheck.sample_conditions(table(spark, sf, "conditions").filter("not is_control and qc_pass"), 200, "20260926")


@query(f"""WITH {_Y}, k AS (SELECT condition_id, {_KEY("drug")} AS drug, {_UP("cell_line")} AS cell_line, dose FROM conditions),
    n AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY abs(y) DESC, gene_symbol) AS nth FROM yv QUALIFY nth <= 20)
    SELECT drug, cell_line, dose, condition_id, CAST(nth AS INTEGER) AS nth, gene_symbol, CAST(round_even(y * 100, 0) AS INTEGER) AS measured FROM n JOIN k USING (condition_id)""")
def lookup_top20(spark, sf):
    return exports.lookup_rows(evaluation.best_values(table(spark, sf, "de_sets")), _conditions(spark, sf))


@query()
def lookup_documents(spark, sf):
    return exports.lookup_documents(lookup_top20(spark, sf))
