import math

import pytest
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.functions.text import lower_key, plate_key, split_key, strip_blanks
from tests.conftest import rows


def one(spark, column, **values):
    import pyspark.sql.types as T

    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.StringType(), list: T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()] or [T.StructField("x", T.LongType())])
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column).first()[0]


@pytest.mark.parametrize("raw", ["abc", " abc", "abc\t", " abc ​", "　abc\r\n"])
def test_strip_blanks(spark, raw):
    assert one(spark, strip_blanks("v"), v=raw) == "abc"


def test_keys(spark):
    assert one(spark, plate_key("v"), v=" PLATE012 ") == "plate12"
    assert one(spark, plate_key("v"), v="plate") == "plate"
    assert one(spark, lower_key("v"), v=None) is None
    assert one(spark, split_key("v"), v=" Unseen-Drug") == "unseen_drug"


def test_treatment_text(spark):
    text = "[('Drug (base)', 0.05, 'uM')]"
    assert one(spark, S.drug_of("v"), v=text) == "Drug (base)"
    assert one(spark, S.dose_of("v"), v=text) == 0.05
    assert one(spark, S.unit_of("v"), v=text) == "uM"
    assert one(spark, S.drug_of("v"), v="plain") == "plain" and one(spark, S.dose_of("v"), v="plain") is None
    assert one(spark, S.drug_of("v"), v="") is None and one(spark, S.drug_of("v"), v=None) is None


def test_control_is_the_exact_name(spark):
    assert one(spark, S.is_control("v"), v=" dmso_TF ") is True
    assert one(spark, S.is_control("v"), v="X (DMSO_TF solvate)") is False
    assert one(spark, S.is_control("v"), v=None) is False


def test_condition_id_matches_a_plain_sha1(spark):
    import hashlib

    want = hashlib.sha1(b"L|D|None|p1").hexdigest()[:16]
    assert one(spark, S.condition_id("a", "b", "c", "d"), a="L", b="D", c=None, d="p1") == want


def test_units(spark):
    assert one(spark, S.to_micromolar("d", "u"), d=5.0, u="nM") == pytest.approx(0.005)
    assert one(spark, S.to_micromolar("d", "u"), d=5.0, u=None) is None
    with pytest.raises(Exception, match="unknown dose unit"):
        one(spark, S.to_micromolar("d", "u"), d=5.0, u="kg")


def test_whole_number(spark):
    assert one(spark, S.whole_number(F.col("v"), F.lit("g")), v=4.0) == 4
    with pytest.raises(Exception, match="fractional"):
        one(spark, S.whole_number(F.col("v"), F.lit("g")), v=4.5)


def test_hundredths_round_half_to_even(spark):
    assert one(spark, S.hundredths(F.col("v")), v=0.125) == 12 and one(spark, S.hundredths(F.col("v")), v=-0.375) == -38
    with pytest.raises(Exception, match="finite"):
        one(spark, S.hundredths(F.col("v")), v=math.nan)


def test_pearson_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert df.agg(S.pearson(F.col("x"), F.col("y"))).first()[0] == 0.0
    assert df.agg(S.pearson(F.col("x"), F.col("x"))).first()[0] == pytest.approx(1.0)
    assert df.limit(0).agg(S.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_average_rank(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 2.0), ("k", 9.0)], "k string, x double")
    assert [r[0] for r in df.select(S.average_rank("x", ["k"]).alias("r")).orderBy("r").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_tanimoto(spark):
    df = spark.createDataFrame([([5, 0, 0], [4, 0, 0]), ([5, 0, 0], [0, 0, 5]), ([0, 0], [0, 0])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(S.count_tanimoto(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0, 0.0]


def test_slug(spark):
    slug = one(spark, S.file_slug("v"), v="a b/c" * 20)
    assert len(slug) == 49 and " " not in slug and "/" not in slug
    assert rows(spark.range(1).select(S.close_to(F.lit(1.0), F.lit(1.0 + 1e-8)))) == [(True,)]


def test_numbers_in_ids_read_as_their_shortest_text(spark):
    values = [0.0, 0.05, 0.5, 5.0, 1e-3, 5e-4, 1.25e-4, 1e-4, 1e-5, 2.5e-7, 1e7, 12345678.5, 123456789012.25, 1e15, 1e16, 2.5e16, 1e100, 1e-100, -1e-5, -5e-4, -2e7, 999999.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert [r[0] for r in df.select(S.number_text("v")).collect()] == [*map(repr, values), None]
