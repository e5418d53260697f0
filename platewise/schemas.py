"""Declared schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


PSEUDOBULK = "condition_id string, gene int, sum_counts int, n_cells int, library_size bigint"
LOGFC = "condition_id string, control_condition_id string, gene int, logfc float"


def struct(name: str) -> T.StructType:
    """The declared schema of a table by its constant's name, e.g. ``struct('LOGFC')``."""
    return _schema(globals()[name])
