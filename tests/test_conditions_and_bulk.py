import math

import pytest
from pyspark.sql import functions as F

from platewise import schemas
from platewise.operators import conditions as C
from platewise.operators import contracts, pseudobulk, quality
from platewise.operators.contracts import ContractError
from tests.conftest import rows

WELLS = "cell_line string, plate string, sample string, drug string, drugname_drugconc string, n_cells long, extra int"


@pytest.fixture()
def wells(spark):
    return spark.createDataFrame(
        [
            ("L1", "plate1", "s1", "A", "[('A', 0.5, 'uM')]", 10, 1),
            ("L1", "plate1", "s1", "A", "[('A', 0.5, 'uM')]", 10, 2),  # sent twice
            ("L1", "plate1", "s2", "DMSO_TF", "[('DMSO_TF', 0.0, 'uM')]", 5, 1),
            ("L1", "plate01 ", "s3", "DMSO_TF", "[('DMSO_TF', 0.0, 'uM')]", 6, 1),  # a second control well
            (None, "plate1", "s4", "A", "[('A', 0.5, 'uM')]", 1, 1),
            ("L1", "plate2", "s5", "A", "[('A', 0.5, 'uM')]", 3, 1),
        ],
        WELLS,
    )


@pytest.fixture()
def cells(spark):
    data = [("s1", "plate1", "l1 ", [1, 10, 11], [-2.0, 4.0, 1.0]), ("S2", "Plate1", "L1", [1, 10], [-2.0, 1.0]), ("s3", "plate1", "L1", [1, 10, 12], [-2.0, 1.0, 2.0]), ("s9", "plate1", "L1", [1, 10], [-2.0, 9.0]), (None, "plate1", "L1", [1], [-2.0])]
    return pseudobulk.clean_cells(spark.createDataFrame(data, "sample string, plate string, cell_line string, genes array<long>, expressions array<float>"))


def test_replicate_wells_add_up_and_controls_are_found(wells):
    table = C.assign_controls(C.condition_table(wells))
    got = {(r["drug_name"], r["plate"]): (r["n_cells_atlas"], r["control_condition_id"] is not None) for r in table.collect()}
    assert got == {("A", "plate1"): (10, True), ("DMSO_TF", "plate1"): (11, True), ("A", "plate2"): (3, False)}
    control = table.filter("is_control").first()
    assert control["condition_id"] == control["control_condition_id"]


def test_two_controls_raise(spark, wells):
    table = C.condition_table(wells)
    twice = table.union(table.filter("is_control").withColumn("condition_id", F.lit("other")))
    with pytest.raises(ContractError):
        C.assign_controls(twice)


def test_profiles_and_fold_changes_by_hand(spark, wells, cells):
    bulk = pseudobulk.pseudobulk(cells, C.condition_lookup(wells))
    names = {r["condition_id"]: r["drug_name"] for r in C.condition_table(wells).collect()}
    got = sorted((names[r["condition_id"]], r["gene"], r["sum_counts"], r["n_cells"], r["library_size"]) for r in bulk.collect())
    assert got == [("A", 10, 4, 1, 5), ("A", 11, 1, 1, 5), ("DMSO_TF", 10, 2, 2, 4), ("DMSO_TF", 12, 2, 2, 4)]
    contracts.check_schema(bulk.select(*[f.name for f in schemas.struct("PSEUDOBULK").fields]), schemas.struct("PSEUDOBULK"), "pseudobulk")
    table = quality.qc_flags(quality.with_processed_cells(C.assign_controls(C.condition_table(wells)), bulk.select("condition_id", "n_cells").distinct()), 1, 2)
    fold = {r["gene"]: r["logfc"] for r in pseudobulk.log_fold_changes(bulk, table).collect()}
    assert fold[10] == pytest.approx(math.log(800001) - math.log(500001), rel=1e-6)
    assert fold[11] == pytest.approx(math.log(200001), rel=1e-6) and fold[12] == pytest.approx(-math.log(500001), rel=1e-6)
    strict = quality.qc_flags(table.drop("qc_pass"), 1, 3)
    assert pseudobulk.log_fold_changes(bulk, strict).count() == 0


def test_fraction_raises(spark, wells):
    bad = pseudobulk.clean_cells(spark.createDataFrame([("s1", "plate1", "L1", [10], [0.5])], "sample string, plate string, cell_line string, genes array<long>, expressions array<float>"))
    with pytest.raises(Exception, match="fractional"):
        pseudobulk.pseudobulk(bad, C.condition_lookup(wells)).collect()


def test_uneven_arrays_and_empty_tables(spark, wells):
    schema = "sample string, plate string, cell_line string, genes array<long>, expressions array<float>"
    odd = pseudobulk.clean_cells(spark.createDataFrame([("s1", "plate1", "L1", [1, 7, 8], [-2.0, 3.0]), ("s1", "plate1", "L1", None, None)], schema))
    assert rows(pseudobulk.sums_per_well(odd).select("gene", "total")) == [(7, 3.0)]
    # sums and the number of cells (the row without a gene) in one pass; a cell without arrays is counted
    assert rows(pseudobulk.totals(odd, ["sample"])) == [("s1", 7, 3.0), ("s1", None, 2.0)]
    assert pseudobulk.pseudobulk(odd.limit(0), C.condition_lookup(wells)).count() == 0
    assert rows(pseudobulk.zero_genes(odd.select(F.lit(7).cast("long").alias("gene")), spark.createDataFrame([(7,), (9,), (8,)], "gene long"))) == [(2, "8,9")]


def test_quality_report(spark):
    t = spark.createDataFrame([("a", "L", False, 2, "c", "p"), ("c", "L", True, 9, "c", "p"), ("b", "L", False, 5, None, "p")], "condition_id string, cell_line string, is_control boolean, n_cells int, control_condition_id string, plate string")
    flagged = quality.qc_flags(t, 3, 10)
    assert rows(quality.dropped(flagged, 3, 10)) == [("a", "treated condition with 2 cells, 3 needed"), ("c", "control condition with 9 cells, 10 needed")]
    s = quality.summary(flagged).first()
    assert (s["n_kept"], s["n_controls_kept"], s["n_without_control"], s["mean_kept_cells"], s["status"]) == (1, 0, 1, 5.0, "warnings")
    assert quality.summary(flagged.limit(0)).first()["status"] == "empty"


CONTRACT_ROWS = "condition_id string, cell_line string, drug_name string, dose double, is_control boolean, plate string, n_cells long, depmap_id string, qc_pass boolean, control_condition_id string"


@pytest.mark.parametrize(
    "change, word",
    [({"depmap_id": None}, "external_id"), ({"n_cells": -1}, "negative_cells"), ({"control_condition_id": None}, "without_control"), ({"plate": None}, "null_key")],
)
def test_condition_contract(spark, change, word):
    good = {"condition_id": "a", "cell_line": "L", "drug_name": "D", "dose": 1.0, "is_control": False, "plate": "p", "n_cells": 3, "depmap_id": "x", "qc_pass": True, "control_condition_id": "c"}
    contracts.check_conditions(spark.createDataFrame([tuple(good.values())], CONTRACT_ROWS))
    with pytest.raises(ContractError, match=word):
        contracts.check_conditions(spark.createDataFrame([tuple({**good, **change}.values())], CONTRACT_ROWS))


def test_other_contracts(spark):
    conditions = spark.createDataFrame([("a", 2)], "condition_id string, n_cells int")
    bulk = lambda *r: spark.createDataFrame(list(r), schemas.PSEUDOBULK)
    contracts.check_pseudobulk(bulk(("a", 5, 1, 2, 1)), conditions)
    for bad in [[("a", 5, -1, 2, 1)], [("a", 1, 1, 2, 1)], [("a", 5, 1, 2, 1), ("a", 5, 1, 2, 1)], [("b", 5, 1, 2, 1)], [("a", 5, 1, 3, 1)]]:
        with pytest.raises(ContractError):
            contracts.check_pseudobulk(bulk(*bad), conditions)
    with pytest.raises(ContractError):
        contracts.check_schema(conditions, schemas.struct("LOGFC"), "logfc")
    with pytest.raises(ContractError):
        contracts.check_gene_coverage(bulk(("a", 5, 1, 2, 1)), spark.createDataFrame([(6,)], "gene int"))
    with pytest.raises(ContractError):
        contracts.check_model_info({"fallback_rate": 1.5})
    with pytest.raises(ContractError):
        contracts.check_model_info({"x": object()})
    assert contracts.null_profile(spark.createDataFrame([(None, 1.0), ("a", math.nan)], "a string, b double")).first().asDict() == {"n_rows": 2, "nulls_a": 1, "nulls_b": 0, "nans_b": 1, "infs_b": 0}
