"""Scalar rules of the screening domain as Spark columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from platewise.functions.text import lower_key

#: The treatment text ``('name', dose, 'unit')`` and the vehicle's exact names.
DOSE_PATTERN = r"\(\s*'([^']+)'\s*,\s*([0-9]*\.?[0-9]+(?:[eE][-+]?\d+)?)\s*,\s*'([^']+)'\s*\)"
CONTROL_NAMES = ("dmso_tf",)
#: Micromolar in one unit; the micro sign and the Greek letter are both in use.
UNIT_TO_MICROMOLAR = {"nM": 1e-3, "uM": 1.0, "\u00b5M": 1.0, "\u03bcM": 1.0, "mM": 1e3}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drug_of(text: Column | str) -> Column:
    """The drug named in a treatment text; a text of another form is the name itself; null and '' give null."""
    c = _col(text)
    return F.when(c.rlike(DOSE_PATTERN), F.regexp_extract(c, DOSE_PATTERN, 1)).when(c != "", c)


def dose_of(text: Column | str) -> Column:
    c = _col(text)
    return F.when(c.rlike(DOSE_PATTERN), F.regexp_extract(c, DOSE_PATTERN, 2).cast("double"))


def unit_of(text: Column | str) -> Column:
    c = _col(text)
    return F.when(c.rlike(DOSE_PATTERN), F.regexp_extract(c, DOSE_PATTERN, 3))


def is_control(drug: Column | str, names: Sequence[str] = CONTROL_NAMES) -> Column:
    """Whether the name is exactly a vehicle's (blanks and case aside); a name that merely contains it is not. Null is no control."""
    return F.coalesce(lower_key(drug).isin([n.lower() for n in names]), F.lit(False))


def number_text(c: Column | str) -> Column:
    """A double as its shortest decimal text: plain from 1e-4 up to 1e16 (``0.0005``, ``10000000.0``), else with a two-digit exponent (``1e-05``, ``2.5e+16``), as ids of conditions were made from. Null stays null."""
    c = _col(c).cast("double")
    size, text = F.abs(c), c.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?(\d+\.\d+)E", 1)
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.translate(mantissa, ".", ""), r"0+$", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = exponent + 1
    large = F.when(F.length(digits) <= whole, F.concat(F.rpad(digits, whole, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), whole), F.lit("."), F.substring(digits, whole + 1, F.length(digits))))
    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), power)
    plain = (size >= 1e-4) & (size < 1e16)
    return F.when(exponent.isNull(), text).when(plain & (size < 1), F.concat(sign, small)).when(plain, F.concat(sign, large)).otherwise(F.concat(sign, scientific))


def condition_id(*parts: Column | str) -> Column:
    """First 16 hex digits of the sha1 of the parts joined by ``|``; a null part reads ``None``. Doubles go in by :func:`number_text`."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("None")) for p in parts])), 1, 16)


def counts_per_million(count: Column | str, library: Column | str) -> Column:
    return F.when(_col(library) > 0, _col(count).cast("double") / _col(library).cast("double") * F.lit(1e6)).otherwise(F.lit(0.0))


def log_fold_change(treated: Column, control: Column) -> Column:
    """ln(1 + treated) - ln(1 + control); null counts as 0."""
    return F.log(F.lit(1.0) + F.coalesce(treated, F.lit(0.0))) - F.log(F.lit(1.0) + F.coalesce(control, F.lit(0.0)))


def to_micromolar(dose: Column | str, unit: Column | str, table: Mapping[str, float] = UNIT_TO_MICROMOLAR) -> Column:
    """The dose in micromolar; a null dose or unit gives null, an unknown unit raises when the value is used."""
    d, u = _col(dose), _col(unit)
    factor = F.when(u.isNull(), F.lit(None).cast("double"))
    for name, value in table.items():
        factor = factor.when(u == name, F.lit(value))
    return d * factor.otherwise(F.raise_error(F.concat(F.lit("unknown dose unit: "), u)).cast("double"))


def log10_dose(control: Column, micromolar: Column) -> Column:
    """log10 of the dose for treated conditions; controls and non-positive doses have none."""
    return F.when(~control & (micromolar > 0), F.log10(micromolar))


def whole_number(total: Column, what: Column) -> Column:
    """``total`` as int; a fractional value raises, naming ``what``. Only fires where the column is consumed."""
    return F.when(total == F.round(total), total.cast("int")).otherwise(F.raise_error(F.concat(F.lit("fractional count for "), what.cast("string"))).cast("int"))


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r from centred sums kept by Spark's own covariance and deviations; 0 where either side is constant, null for no rows."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when(F.count(x) == 0, F.lit(None).cast("double")).when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy)).otherwise(F.lit(0.0))


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank of column ``x`` within ``keys`` with ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / F.lit(2.0)


def count_tanimoto(a: Column, b: Column) -> Column:
    """sum(min) / sum(max) of two count arrays; 0 where both are all zero."""
    low = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    high = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.when(high > 0, low / high).otherwise(F.lit(0.0))


def hundredths(x: Column) -> Column:
    """The value in hundredths as int, halves to even; a non-finite value raises."""
    return F.when(finite(x), F.rint(x * 100).cast("int")).otherwise(F.raise_error(F.lit("value is not finite")).cast("int"))


def close_to(a: Column, b: Column, relative: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.lit(relative) * F.abs(b)


def file_slug(name: Column | str) -> Column:
    """A file-safe name: other characters as ``_``, at most 40, plus eight hex digits of the name's sha1."""
    c = _col(name)
    return F.concat(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "_"), 1, 40), F.lit("-"), F.substring(F.sha1(c), 1, 8))
