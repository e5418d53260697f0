import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions.text import lower_key
from platewise.operators import compaction, skew
from tests.conftest import rows


def test_hilbert_curve_visits_every_cell_once_and_steps_by_one():
    side = 16
    x, y = map(np.ravel, np.meshgrid(np.arange(side), np.arange(side)))
    place = compaction.hilbert_index(x, y, 4)
    assert sorted(place) == list(range(side * side))
    order = np.argsort(place)
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()


CELLS = "shard long, plate string, sample string, barcode_sub_lib_id string, genes array<long>, expressions array<float>, ingested_at timestamp, __file int, rows int"


def cells(spark, data):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, p, q, b, [1, 5], [-2.0, float(i)], t, 1, 2) for i, (s, p, q, b) in enumerate(data)], CELLS)


def brute_pairs(data):
    where = {}
    for s, p, q, b in data:
        if None not in (s, p, q, b):
            where.setdefault((p, q, b), set()).add(s)
    return sorted({(x, y) for shards in where.values() for x in shards for y in shards if x < y})


def test_shared_fragments_against_brute_force(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(12), f"plate{rnd.randrange(2)}", f"smp_{rnd.choice([1, 1, 1, 7])}", f"b{rnd.randrange(40)}") for _ in range(300)]
    data += [(1, None, "smp_1", "b1"), (2, None, "smp_1", "b1"), (None, "plate0", "smp_1", "b1"), (3, "plate0", None, "b9")]
    got = sorted(rows(compaction.shared_fragments(cells(spark, data), rows_per_file=20)))
    assert got == brute_pairs(data)
    assert rows(compaction.shared_fragments(cells(spark, [(1, "PLATE01 ", " Smp_1", "B1"), (2, "plate1", "smp_1", "b1")]))) == [(1, 2)]
    assert compaction.shared_fragments(cells(spark, data).limit(0)).count() == 0


def test_compaction_keeps_every_cell_once_in_even_files(spark):
    rnd = random.Random(5)
    data = [(i % 50, "plate1", "smp_1" if rnd.random() < 0.6 else f"smp_{rnd.randrange(30)}", f"b{i}") for i in range(2000)]
    data += data[:100] + [(1, None, "smp_1", "b1"), (1, None, "smp_1", "b1")]
    df = cells(spark, data).drop("__file", "rows")
    path = tempfile.mkdtemp() + "/out"
    df = df.withColumn("file", F.lit(9)).withColumn("row", F.lit("x"))
    r = compaction.compact(df, path, rows_per_file=200).first()
    assert (r["rows_in"], r["copies_left_out"], r["rows_out"], r["digest_equal"]) == (2102, 100, 2002, True)
    assert r["largest_file"] <= 3 * 200 and 6 <= r["files"] <= 14
    back = spark.read.parquet(path + "/cells")
    assert back.columns == df.columns and back.filter("barcode_sub_lib_id is not null and plate is not null").groupBy("plate", "sample", "barcode_sub_lib_id").count().filter("count > 1").count() == 0
    empty = compaction.compact(df.limit(0), tempfile.mkdtemp() + "/out").first()
    assert (empty["rows_in"], empty["rows_out"], empty["digest_equal"]) == (0, 0, True)


def test_a_cell_with_very_many_copies(spark):
    data = [(i % 600, "plate1", "smp_1", "hot") for i in range(1500)] + [(i % 7, "plate2", "smp_2", f"b{i}") for i in range(60)]
    df = cells(spark, data)
    r = compaction.compact(df, tempfile.mkdtemp() + "/out", rows_per_file=100).first()
    assert (r["rows_out"], r["copies_left_out"], r["digest_equal"]) == (61, 1499, True)
    assert rows(compaction.shared_fragments(df, rows_per_file=100)) == sorted(brute_pairs(data), key=repr)


def test_the_pairs_come_out_of_the_written_files(spark, monkeypatch):
    df = cells(spark, [(1, "plate1", "smp_1", "b1"), (2, "plate1", "smp_1", "b1")])
    assert rows(compaction.shared_fragments(df)) == [(1, 2)]
    monkeypatch.setattr(compaction.Layout, "place", lambda self, rows: rows.withColumn("file", F.lit(0)).limit(0))
    with pytest.raises(RuntimeError):
        compaction.shared_fragments(df)


def test_join_with_heavy_keys(spark):
    left = spark.createDataFrame([("h", i) for i in range(900)] + [(f"k{i % 150}", i) for i in range(300)] + [(None, -1)], "key string, v int")
    right = spark.createDataFrame([("h", 1), *[(f"k{i}", i) for i in range(0, 150, 2)]], "key string, label int")
    want = sorted(((r[0], r[1], r[2]) for r in left.join(right, "key", "left").collect()), key=repr)
    assert rows(skew.join_heavy(left, right, "key", one_in=10)) == want
    assert skew.join_heavy(left.limit(0), right, "key").count() == 0


def test_counts_and_sums_survive_a_heavy_key(spark):
    data = [("h" if i % 3 else f"k{i % 7}", i, [1, i % 5], [-2.0, 1.0]) for i in range(3000)] + [(None, 1, [1, 2], [-2.0, 3.0]), ("u", 2, [1, 2, 3], [-2.0, 1.0]), ("v", 3, None, None)]
    df = spark.createDataFrame(data, "key string, n long, genes array<long>, expressions array<float>")
    want = {}
    for k, *_ in data:
        want[k] = want.get(k, 0) + 1
    assert dict(rows(skew.count_by_key(df, F.col("key"), [F.xxhash64("n")]))) == want
    spread = skew.range_cut(df, F.col("key"), [F.xxhash64("n")], {}, 8).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 3 * len(data) / 8  # the heavy key alone is two thirds of the rows
    sums = {(k, g): (t, n) for k, g, t, n in rows(skew.sum_sparse_by_key(df, F.col("key"), [F.xxhash64("n")], F.col("genes"), F.col("expressions")))}
    brute = {}
    for k, _, g, e in data:
        for a, b in zip(g or [], e or []):
            if a != 1:
                t, n = brute.get((k, a), (0.0, 0))
                brute[k, a] = (t + b, n + 1)
    assert sums == brute


@pytest.mark.parametrize("n, found", [(25, [("key", "a")]), (2, [])])
def test_heavy_keys_count_every_row(spark, n, found):
    data = [("A " if i % 2 else " a", i) for i in range(4)] + [(f"x{i}", i) for i in range(90)] + [(None, i) for i in range(6)]
    df = spark.createDataFrame(data, "key string, n long")
    assert [r[:2] for r in rows(skew.heavy_keys(df, {"key": lower_key("key")}, n, [F.xxhash64("n")]))] == found
    assert skew.heavy_keys(df.limit(0), {"key": F.col("key")}, n, [F.xxhash64("n")]).count() == 0


def test_places_and_percentiles_of_a_group_cut_by_partitions(spark):
    rnd = random.Random(4)
    data = [("h" if i % 3 else rnd.choice(["a", "b", None]), rnd.choice([rnd.random(), 0.5])) for i in range(3000)] + [("one", 7.0)]
    df = spark.createDataFrame(data, "key string, v double")
    placed = skew.places(df, ["key"], "v")
    got = {}
    for r in placed.collect():
        got.setdefault(r["key"], []).append((r["place"], r["v"], r["group_rows"]))
    want = {k: sorted(v for key, v in data if key == k) for k in {k for k, _ in data}}
    assert {k: [v for _, v, _ in sorted(x)] for k, x in got.items()} == want
    assert all([p for p, _, _ in sorted(x)] == list(range(len(x))) and {n for _, _, n in x} == {len(x)} for x in got.values())
    found = {r["key"]: (r["q1"], r["m"], r["top"]) for r in skew.exact_percentiles(placed, ["key"], "v", {"q1": 0.25, "m": 0.5, "top": 1.0}).collect()}
    assert found == {k: pytest.approx((np.quantile(v, 0.25), np.median(v), max(v))) for k, v in want.items()}
    assert skew.places(df.limit(0), ["key"], "v").count() == 0
