"""Keys with uneven spelling: blanks of any kind around them, letter case, zero padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+"
_AROUND = f"^{_BLANK}|{_BLANK}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c: Column | str) -> Column:
    """The text without blanks of any kind around it (tabs, line ends, no-break and zero-width spaces too); null stays null."""
    return F.regexp_replace(_col(c), _AROUND, "")


def lower_key(c: Column | str) -> Column:
    return F.lower(strip_blanks(c))


def upper_key(c: Column | str) -> Column:
    return F.upper(strip_blanks(c))


def plate_key(c: Column | str) -> Column:
    """``plate`` followed by its number without zero padding; other texts in lower case, trimmed."""
    return F.regexp_replace(lower_key(c), r"^plate[\s_-]*0*(\d+)$", "plate$1")


def split_key(c: Column | str) -> Column:
    """Split names: trimmed, lower case, ``_`` for ``-``."""
    return F.translate(lower_key(c), "-", "_")


#: The same rules for the SQL side of the checks (DuckDB).
SQL_AROUND = r"^[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+$"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{SQL_AROUND}', '', 'g')"


def sql_plate(expr: str) -> str:
    return rf"regexp_replace(lower({sql_strip(expr)}), '^plate[\s_-]*0*(\d+)$', 'plate\1')"
