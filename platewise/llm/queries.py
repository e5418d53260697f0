"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions.text import lower_key, split_key, sql_strip, strip_blanks, upper_key
from platewise.llm import leaks, mixture, quantiles, related, residue, topn
from platewise.session import materialize, table

SCORE_KEYS = ["split", "repeat"]
AT = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
#: Values per compactor at the top level.
K = 2048
#: A compactor so small that groups of the checked tables are compacted many times.
SMALL_K = 64


def _daily_states(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """One state per split, repeat and day: what a pipeline would keep of each day."""
    keys = [*SCORE_KEYS, "loaded_on"]
    parts = quantiles.sketch(table(spark, sf, "per_condition"), [split_key("split"), F.col("repeat"), F.col("loaded_on")], keys, F.col("de_pearson"), k)
    return materialize(quantiles.merge(parts, keys, k), "daily-states")


def _all_days(days: DataFrame, k: int) -> DataFrame:
    return quantiles.percentiles(quantiles.merge(days, SCORE_KEYS, k), SCORE_KEYS, AT)


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the finite de_pearson values per split and repeat, of every single day and of all days together, from the same stored states.

    (level, split, repeat, loaded_on, n_values, min_value, max_value, q, value, rank_error); ``level`` is ``day``, or ``all`` with a null loaded_on."""
    days = _daily_states(spark, sf, K)
    daily = quantiles.percentiles(days, [*SCORE_KEYS, "loaded_on"], AT).withColumn("level", F.lit("day"))
    whole = _all_days(days, K).withColumns({"level": F.lit("all"), "loaded_on": F.lit(None).cast("date")})
    return daily.unionByName(whole).select("level", *SCORE_KEYS, "loaded_on", "n_values", "min_value", "max_value", "q", "value", "rank_error")


def p1_daily_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The days of p1_percentiles alone."""
    return quantiles.percentiles(_daily_states(spark, sf, K), [*SCORE_KEYS, "loaded_on"], AT)


def p1_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of small compactors, merged from days, held against exact ranks over all rows: (split, repeat, q, n_values, compacted, within_bound).

    ``compacted`` says whether anything was given up for the answer, so whether its bound is a real one: so in every group of more than SMALL_K values."""
    answers = _all_days(_daily_states(spark, sf, SMALL_K), SMALL_K)
    values = table(spark, sf, "per_condition").select(split_key("split").alias("split"), "repeat", F.col("de_pearson").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('inf')")
    # equal values are counted once each; the answers are a few rows per group
    counted = values.groupBy("split", "repeat", "v").agg(F.count(F.lit(1)).alias("c"))
    a = answers.select(F.col("split").alias("s"), F.col("repeat").alias("r"), F.col("n_values").alias("n"), "q", "value", F.col("rank_error").alias("e"))
    joined = counted.join(a, F.col("split").eqNullSafe(F.col("s")) & F.col("repeat").eqNullSafe(F.col("r")))
    below = lambda test: F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0))
    ranks = joined.groupBy("split", "repeat", "q", "n", "e").agg(F.sum("c").alias("n_values"), below(F.col("v") < F.col("value")).alias("below"), below(F.col("v") <= F.col("value")).alias("upto"))
    wide = F.col("e") * F.col("n") + 1
    within = (F.col("n") == F.col("n_values")) & (F.col("below") <= F.col("q") * F.col("n") + wide) & (F.col("upto") >= F.col("q") * F.col("n") - wide)
    return ranks.select("split", "repeat", "q", "n_values", (F.col("e") > 0).alias("compacted"), within.alias("within_bound"))


SPLIT_UNITS = {"random": [], "unseen_drug": ["cluster"], "unseen_cell_line": ["cell_line"], "both_unseen": ["cluster", "cell_line"]}


def _condition_units(spark: SparkSession, sf: str) -> DataFrame:
    """(condition_id, is_control, cluster, cell_line) per condition; a drug without an entry in drug_groups has no cluster."""
    groups = table(spark, sf, "drug_groups").filter("drug is not null and cluster_id is not null").groupBy(lower_key("drug").alias("drug_key")).agg(F.min("cluster_id").cast("string").alias("cluster"))
    conditions = table(spark, sf, "conditions").select("condition_id", "is_control", upper_key("cell_line").alias("cell_line"), lower_key("drug").alias("drug_key"))
    return conditions.join(groups, "drug_key", "left").select("condition_id", "is_control", "cluster", "cell_line")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    delivered = table(spark, sf, "splits").filter("part is not null").select("repeat", split_key("split").alias("split"), "condition_id", "part").distinct()
    units = _condition_units(spark, sf)
    split = F.col("split")
    joined = delivered.join(units, "condition_id", "left")
    kinds = F.array(
        F.struct(F.lit("condition").alias("unit_kind"), F.when(split == "random", F.col("condition_id")).alias("unit")),
        F.struct(F.lit("cluster").alias("unit_kind"), F.when(split.isin("unseen_drug", "both_unseen"), F.col("cluster")).alias("unit")),
        F.struct(F.lit("cell_line").alias("unit_kind"), F.when(split.isin("unseen_cell_line", "both_unseen"), F.col("cell_line")).alias("unit")),
    )
    rows = joined.select("repeat", "split", F.col("condition_id").alias("rec"), "part", F.inline(kinds))
    return related.torn_units(rows, ["repeat", "split", "unit_kind"])


def p2_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """(split, condition_id, part): every treated condition gets a part in every split; units that the split's name demands stay whole."""
    treated = _condition_units(spark, sf).filter(~F.coalesce(F.col("is_control"), F.lit(False)))
    out = None
    for name, kinds in SPLIT_UNITS.items():
        one = related.group_split(treated, "condition_id", {k: F.col(k) for k in kinds}, seed=name).select(F.lit(name).alias("split"), "condition_id", "part")
        out = one if out is None else out.union(one)
    return out


def p2_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Per split: rows of p2_assignment, different conditions, and rows without one of the three parts; every treated condition once."""
    part = F.coalesce(F.col("part"), F.lit("")).isin(list(related.PARTS))
    return p2_assignment(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("condition_id").alias("n_conditions"), F.count_if(~part).alias("n_without_part"))


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What each part of p2_assignment really holds: (split, part, n_conditions, share, target)."""
    counted = p2_assignment(spark, sf).groupBy("split", "part").agg(F.count(F.lit(1)).alias("n_conditions"))
    total = counted.groupBy("split").agg(F.sum("n_conditions").alias("n"))
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in related.PARTS.items() for x in kv]), F.col("part"))
    return counted.join(total, "split").select("split", "part", "n_conditions", F.round(F.col("n_conditions") / F.col("n"), 6).alias("share"), goal.alias("target"))


def p2_both_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """(condition_id, cluster_part, cell_line_part, part): lines and clusters are split each on its own; a condition whose two parts differ is left out (null part).

    The whole both_unseen graph is nearly one component, which p2_assignment can only give to one part; this second answer reaches all three parts."""
    treated = _condition_units(spark, sf).filter(~F.coalesce(F.col("is_control"), F.lit(False)))
    return related.crossed_split(treated, "condition_id", {k: F.col(k) for k in SPLIT_UNITS["both_unseen"]}, seed="both_unseen")


def p2_both_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What p2_both_unseen keeps: (part, n_conditions, share, target), the share being of the conditions kept; the row without a part counts those left out."""
    counted = p2_both_unseen(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("n_conditions"))
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in related.PARTS.items() for x in kv]), F.col("part"))
    kept = F.sum(F.when(F.col("part").isNotNull(), F.col("n_conditions"))).over(Window.partitionBy())  # four rows
    return counted.select("part", "n_conditions", F.when(F.col("part").isNotNull(), F.round(F.col("n_conditions") / kept, 6)).alias("share"), goal.alias("target"))


def p2_both_torn(spark: SparkSession, sf: str) -> DataFrame:
    """Units with kept conditions in more than one part of p2_both_unseen, counted per kind: all zero."""
    units = _condition_units(spark, sf)
    kept = p2_both_unseen(spark, sf).join(units, "condition_id")
    kinds = F.array(F.struct(F.lit("cluster").alias("unit_kind"), F.col("cluster").alias("unit")), F.struct(F.lit("cell_line").alias("unit_kind"), F.col("cell_line").alias("unit")))
    per = kept.select("part", F.inline(kinds)).filter("unit is not null").groupBy("unit_kind", "unit").agg(F.countDistinct("part").alias("parts"))
    return per.groupBy("unit_kind").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("parts") > 1).alias("n_torn"))


def p2_torn_after(spark: SparkSession, sf: str) -> DataFrame:
    """Units torn by p2_assignment, counted per split and kind: all zero."""
    units = _condition_units(spark, sf).filter(~F.coalesce(F.col("is_control"), F.lit(False)))
    split = F.col("split")
    rows = p2_assignment(spark, sf).join(units, "condition_id")
    kinds = F.array(
        F.struct(F.lit("cluster").alias("unit_kind"), F.when(split.isin("unseen_drug", "both_unseen"), F.col("cluster")).alias("unit")),
        F.struct(F.lit("cell_line").alias("unit_kind"), F.when(split.isin("unseen_cell_line", "both_unseen"), F.col("cell_line")).alias("unit")),
    )
    per = rows.select("split", "part", F.inline(kinds)).filter("unit is not null").groupBy("split", "unit_kind", "unit").agg(F.countDistinct("part").alias("parts"))
    return per.groupBy("split", "unit_kind").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("parts") > 1).alias("n_torn"))


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_items(table(spark, sf, "de_sets"), F.col("condition_id"), strip_blanks("gene_symbol"), F.col("padj"), F.abs("log2foldchange"), 10)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select(F.col("g").alias("condition_id"), F.col("item").alias("gene_symbol"))


def p5_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """p5_found with its scores and the rank that holds: (condition_id, gene_symbol, padj, abs_lfc, nth)."""
    return _top(spark, sf).select(F.col("g").alias("condition_id"), F.col("item").alias("gene_symbol"), F.col("primary").alias("padj"), F.col("secondary").alias("abs_lfc"), F.col("nth"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per held-out item: in how many documents it leaked; items that did not leak are listed with 0."""
    found = p6_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return table(spark, sf, "eval_items").select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p7_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.score(table(spark, sf, "documents"))[0].filter("kept_out").select("doc_id")


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that stay once the residue is left out."""
    documents = table(spark, sf, "documents")
    out = residue.score(documents)[0].filter("kept_out").select("doc_id")
    return documents.select("doc_id", "source", "lang", "n_chars").join(out, "doc_id", "left_anti")


def p8_validation(spark: SparkSession, sf: str) -> DataFrame:
    """How the classifier does on mail of unseen hosts, against the weak labels: (figure, n_rows, value).

    ``recall`` and ``precision`` share the rules of the labels with the fit, though not the hosts; ``unseen <family>`` is the share found of a family of rules that the fit never saw."""
    read = materialize(residue.read_documents(table(spark, sf, "documents")), "residue-read")
    fitted = residue.train(read).figures()
    rows = [(k, int(fitted["held_rows"]), float(fitted[k])) for k in ("recall", "precision", "cut")] + [(f"unseen {k}", n, v) for k, (n, v) in residue.unseen_families(read).items()]
    return spark.createDataFrame(rows, "figure string, n_rows long, value double")


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_daily_percentiles": p1_daily_percentiles,
    "p1_within_bound": p1_within_bound,
    "p2_found": p2_found,
    "p2_assignment": p2_assignment,
    "p2_complete": p2_complete,
    "p2_shares": p2_shares,
    "p2_both_unseen": p2_both_unseen,
    "p2_both_shares": p2_both_shares,
    "p2_both_torn": p2_both_torn,
    "p2_torn_after": p2_torn_after,
    "p5_found": p5_found,
    "p5_ranked": p5_ranked,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_corpus": p7_corpus,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_kept": p8_kept,
    "p8_validation": p8_validation,
}

_SPLIT = f"replace(lower({sql_strip('split')}), '-', '_')"
_FINITE = "de_pearson IS NOT NULL AND NOT isnan(de_pearson) AND NOT isinf(de_pearson)"
_UNITS = f"""
g AS (SELECT lower({sql_strip("drug")}) AS drug_key, CAST(min(cluster_id) AS VARCHAR) AS cluster FROM drug_groups WHERE drug IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1),
c AS (SELECT condition_id, is_control, upper({sql_strip("cell_line")}) AS cell_line, lower({sql_strip("drug")}) AS drug_key FROM conditions),
u AS (SELECT condition_id, is_control, cluster, cell_line FROM c LEFT JOIN g USING (drug_key))"""
_RANKED = f"""
t AS (SELECT condition_id, {sql_strip("gene_symbol")} AS gene_symbol, padj, abs(log2foldchange) AS abs_lfc FROM de_sets
      WHERE condition_id IS NOT NULL AND gene_symbol IS NOT NULL AND padj IS NOT NULL AND log2foldchange IS NOT NULL AND NOT isnan(padj) AND NOT isnan(log2foldchange)),
b AS (SELECT *, row_number() OVER (PARTITION BY condition_id, gene_symbol ORDER BY padj, abs_lfc DESC) AS k FROM t),
r AS (SELECT condition_id, gene_symbol, padj, abs_lfc, row_number() OVER (PARTITION BY condition_id ORDER BY padj, abs_lfc DESC, gene_symbol) AS nth FROM b WHERE k = 1)"""

ORACLE = {
    "p1_within_bound": f"""SELECT s AS split, repeat, q, n AS n_values, n > 64 AS compacted, true AS within_bound FROM
        (SELECT {_SPLIT} AS s, repeat, count(*) AS n FROM per_condition WHERE {_FINITE} GROUP BY 1, 2), (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q)""",
    "p2_found": f"""WITH {_UNITS},
        d AS (SELECT DISTINCT repeat, {_SPLIT} AS split, condition_id, part FROM splits WHERE part IS NOT NULL),
        k AS (SELECT repeat, split, 'condition' AS unit_kind, condition_id AS unit, part FROM d WHERE split = 'random'
              UNION ALL SELECT repeat, split, 'cluster', cluster, part FROM d JOIN u USING (condition_id) WHERE split IN ('unseen_drug', 'both_unseen')
              UNION ALL SELECT repeat, split, 'cell_line', cell_line, part FROM d JOIN u USING (condition_id) WHERE split IN ('unseen_cell_line', 'both_unseen'))
        SELECT repeat, split, unit_kind, unit FROM k WHERE unit IS NOT NULL GROUP BY ALL HAVING count(DISTINCT part) > 1""",
    "p2_torn_after": f"""WITH {_UNITS},
        t AS (SELECT * FROM u WHERE NOT coalesce(is_control, false))
        SELECT split, unit_kind, n_units, CAST(0 AS BIGINT) AS n_torn FROM
          (SELECT 'cluster' AS unit_kind, count(DISTINCT cluster) AS n_units FROM t UNION ALL SELECT 'cell_line', count(DISTINCT cell_line) FROM t)
          JOIN (VALUES ('unseen_drug', 'cluster'), ('unseen_cell_line', 'cell_line'), ('both_unseen', 'cluster'), ('both_unseen', 'cell_line')) AS x(split, unit_kind) USING (unit_kind)""",
    "p2_complete": f"""WITH {_UNITS}, t AS (SELECT DISTINCT condition_id FROM u WHERE NOT coalesce(is_control, false) AND condition_id IS NOT NULL)
        SELECT split, count(*) AS n_rows, count(*) AS n_conditions, CAST(0 AS BIGINT) AS n_without_part FROM t, (SELECT unnest(['random', 'unseen_drug', 'unseen_cell_line', 'both_unseen']) AS split) GROUP BY 1""",
    "p2_both_torn": f"""WITH {_UNITS}, t AS (SELECT * FROM u WHERE NOT coalesce(is_control, false))
        SELECT 'cluster' AS unit_kind, count(DISTINCT cluster) AS n_units, CAST(0 AS BIGINT) AS n_torn FROM t UNION ALL SELECT 'cell_line', count(DISTINCT cell_line), CAST(0 AS BIGINT) FROM t""",
    "p5_found": f"WITH {_RANKED} SELECT condition_id, gene_symbol FROM r WHERE nth <= 10",
    "p5_ranked": f"WITH {_RANKED} SELECT condition_id, gene_symbol, padj, abs_lfc, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 10",
}
