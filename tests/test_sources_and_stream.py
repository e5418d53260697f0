import tempfile

from platewise.operators import pseudobulk
from platewise.sources import readers
from platewise.streaming import ingest
from tests.conftest import rows


def test_pruning_compares_text(spark):
    index = spark.createDataFrame([(1, "plate1", "plate5"), (2, "plate6", "plate9"), (2, "plate6", "plate9"), (3, None, None)], "shard long, plate_min string, plate_max string")
    plates = spark.createDataFrame([("plate10",), (None,)], "plate string")
    assert rows(readers.prune_shards(index, plates)) == [(1,)]


def test_metadata_with_and_without_the_filter(spark):
    base = tempfile.mkdtemp()
    spark.createDataFrame([("p", "full"), ("p", "minimal"), ("q", "full")], "plate string, pass_filter string").write.parquet(base + "/m")
    assert rows(readers.read_metadata(spark, base + "/m", None, ["plate"])) == [("p", 1), ("q", 1)]
    spark.createDataFrame([("p",), ("p",)], "plate string").coalesce(1).write.option("header", True).csv(base + "/c")
    assert rows(readers.read_metadata(spark, None, base + "/c", ["plate"])) == [("p", 2)]


def test_panel(spark):
    wide = spark.createDataFrame([("r", 1.0, None)], "`` string, `G1 (12)` double, `G2 (3)` double")
    assert rows(readers.melt_panel(wide)) == [("r", "G1", 1.0)]
    assert readers.panel_symbols(["G1 (12)", "A (B) (3)"]) == ["G1", "A (B)"]


def test_stream_equals_batch_and_a_restart_adds_nothing(spark):
    base = tempfile.mkdtemp()
    schema = "sample string, plate string, cell_line string, genes array<long>, expressions array<float>"
    data = [(f"s{i % 3}", "plate1", "L", [1, i % 4 + 2], [-2.0, 1.0]) for i in range(60)]
    frame = spark.createDataFrame(data, schema)
    frame.repartition(6).write.parquet(base + "/in")
    q = ingest.ingest(spark, base + "/in", frame.schema, base + "/out", base + "/check", files_per_batch=2)
    q.awaitTermination()
    assert len(ingest.progress(q)) >= 3
    lookup = spark.createDataFrame([("s0", "plate1", "L", "c0"), ("s1", "plate1", "L", "c0"), ("s2", "plate1", "L", "c2")], "sample string, plate string, cell_line string, condition_id string")
    want = rows(pseudobulk.pseudobulk(pseudobulk.clean_cells(frame), lookup))
    assert rows(pseudobulk.merge_partials(ingest.partials(spark, base + "/out"), lookup)) == want
    ingest.ingest(spark, base + "/in", frame.schema, base + "/out", base + "/check").awaitTermination()
    assert rows(pseudobulk.merge_partials(ingest.partials(spark, base + "/out"), lookup)) == want
    assert ingest.log(spark, base + "/out").agg({"cells_kept": "sum"}).first()[0] == 60


def test_another_plate_or_choice_of_lines_touches_no_partial(spark):
    base = tempfile.mkdtemp()
    schema = "sample string, plate string, cell_line string, genes array<long>, expressions array<float>"
    one = spark.createDataFrame([("s", "plate1", "L", [1, 2], [-2.0, 1.0]), ("s", "plate2", "L", [1, 2], [-2.0, 5.0]), ("s", "plate1", "M", [1, 2], [-2.0, 7.0])], schema)
    one.coalesce(1).write.parquet(base + "/in")
    run = lambda choice, lines: ingest.ingest(spark, base + "/in", one.schema, base + "/out", base + "/" + choice, lines=lines).awaitTermination()
    run("all", [])
    files = lambda: {f for f in spark.read.parquet(base + "/out/partials").inputFiles()}
    before = files()
    run("some", ["l ", "K"])
    spark.createDataFrame([("s", "plate3", "L", [1, 2], [-2.0, 9.0])], schema).coalesce(1).write.mode("append").parquet(base + "/in")
    run("all", [])
    assert before < files()
    # the fragment with two plates gave a partial of each
    sums = lambda **k: sorted((r["plate"], r["cell_line"], r["total"]) for r in ingest.partials(spark, base + "/out", **k).filter("gene is not null").collect())
    assert sums() == [("plate1", "L", 1.0), ("plate1", "M", 7.0), ("plate2", "L", 5.0), ("plate3", "L", 9.0)]
    assert sums(lines=["K", "L"]) == [("plate1", "L", 1.0), ("plate2", "L", 5.0)]
    assert sums(plates=["plate2"]) == [("plate2", "L", 5.0)]
