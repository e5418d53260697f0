"""Queries of the general data-preparation operators: compaction of fragments, and results per heavy key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.text import lower_key, sql_plate, sql_strip, upper_key
from platewise.operators import compaction, skew
from platewise.session import scratch_path, table

#: The secondary order inside a key: any fine, even spread of its rows.
def _spread() -> list:
    return [F.xxhash64("barcode_sub_lib_id", "shard")]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.shared_fragments(table(spark, sf, "shard_cells"))


def p3_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """The whole compaction, written into the shared folder and read back: one row of figures."""
    return compaction.compact(table(spark, sf, "shard_cells"), scratch_path(spark, "compacted"), rows_per_file=50_000).select("rows_in", "copies_left_out", "rows_out", "digest_equal")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "shard_cells")
    return skew.heavy_keys(cells, {"cell_line": upper_key("cell_line"), "sample": lower_key("sample")}, 25, _spread()).select("key_field", "key_value")


def _counts(field: str, key):
    return lambda spark, sf: skew.count_by_key(table(spark, sf, "shard_cells"), key(field), _spread()).select(F.col("key_value").alias(field), "n_rows")


def _gene_sums(field: str, key):
    return lambda spark, sf: skew.sum_sparse_by_key(table(spark, sf, "shard_cells"), key(field), _spread(), F.col("genes"), F.col("expressions")).select(
        F.col("key_value").alias(field), "gene", "total", "n_cells"
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_compaction": p3_compaction,
    "p4_found": p4_found,
    "p4_cell_line_counts": _counts("cell_line", upper_key),
    "p4_sample_counts": _counts("sample", lower_key),
    "p4_cell_line_genes": _gene_sums("cell_line", upper_key),
    "p4_sample_genes": _gene_sums("sample", lower_key),
}

_LINE, _SAMPLE = f"upper({sql_strip('cell_line')})", f"lower({sql_strip('sample')})"
_CELLS = f"""c AS (SELECT shard, {sql_plate("plate")} AS p, {_SAMPLE} AS s, lower({sql_strip("barcode_sub_lib_id")}) AS b FROM shard_cells)"""


def _sums_sql(field: str, key: str) -> str:
    return f"""SELECT {field}, gene, sum(CAST(amount AS DOUBLE)) AS total, count(*) AS n_cells FROM
        (SELECT {key} AS {field}, unnest(genes) AS gene, unnest(expressions) AS amount FROM shard_cells) WHERE gene IS NOT NULL AND amount IS NOT NULL AND gene <> 1 GROUP BY 1, 2"""


ORACLE = {
    "p3_found": f"""WITH {_CELLS}, d AS (SELECT DISTINCT * FROM c WHERE shard IS NOT NULL AND p IS NOT NULL AND s IS NOT NULL AND b IS NOT NULL)
        SELECT DISTINCT x.shard AS shard_a, y.shard AS shard_b FROM d x JOIN d y USING (p, s, b) WHERE x.shard < y.shard""",
    "p3_compaction": f"""WITH {_CELLS}, f AS (SELECT count(*) AS n, count(DISTINCT (p, s, b)) AS k FROM c WHERE p IS NOT NULL AND s IS NOT NULL AND b IS NOT NULL)
        SELECT (SELECT count(*) FROM c) AS rows_in, n - k AS copies_left_out, (SELECT count(*) FROM c) - (n - k) AS rows_out, true AS digest_equal FROM f""",
    "p4_found": f"""WITH t AS (SELECT 'cell_line' AS key_field, {_LINE} AS key_value FROM shard_cells UNION ALL SELECT 'sample', {_SAMPLE} FROM shard_cells)
        SELECT key_field, key_value FROM t WHERE key_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 25 >= (SELECT count(*) FROM shard_cells)""",
    "p4_cell_line_counts": f"SELECT {_LINE} AS cell_line, count(*) AS n_rows FROM shard_cells GROUP BY 1",
    "p4_sample_counts": f"SELECT {_SAMPLE} AS sample, count(*) AS n_rows FROM shard_cells GROUP BY 1",
    "p4_cell_line_genes": _sums_sql("cell_line", _LINE),
    "p4_sample_genes": _sums_sql("sample", _SAMPLE),
}
