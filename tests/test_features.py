import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import contracts, features
from platewise.operators.contracts import ContractError
from tests.conftest import rows


def fingerprints(spark, data):
    return spark.createDataFrame(data, "name string, counts array<int>")


def tanimoto(a, b):
    high = sum(map(max, zip(a, b)))
    return sum(map(min, zip(a, b))) / high if high else 0.0


def random_prints(n, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice([0, 0, 1, 3]) for _ in range(12)] for _ in range(4)]
    return [(f"d{i:02d}", [max(0, x + rnd.choice([0, 0, 0, 1, -1])) for x in rnd.choice(base)]) for i in range(n)]


def test_nearest_ties_go_to_the_smaller_name(spark):
    f = fingerprints(spark, [("a", [5, 0, 0]), ("c", [4, 0, 0]), ("b", [4, 0, 0]), ("z", [0, 0, 5]), ("n", None)])
    assert rows(features.nearest_fingerprints(f, f, "name", "counts", block=2)) == [("a", "b", 0.8), ("b", "c", 1.0), ("c", "b", 1.0), ("z", "a", 0.0)]


def test_similar_pairs_against_all_pairs(spark):
    data = random_prints(40, 1)
    got = {(a, b): round(s, 9) for a, b, s in rows(features.similar_pairs(fingerprints(spark, data), "name", "counts", 0.6))}
    want = {(a, b): round(tanimoto(x, y), 9) for (a, x), (b, y) in itertools.combinations(data, 2) if tanimoto(x, y) >= 0.6}
    assert got == want and want
    with pytest.raises(ValueError):
        features.similar_pairs(fingerprints(spark, data), "name", "counts", 0.0)


def greedy(names, pairs):
    near = {n: set() for n in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    left, out = set(names), {}
    while left:
        centre = min(left, key=lambda n: (-len(near[n] & left), n))
        for m in (near[centre] & left) | {centre}:
            out[m] = centre
        left -= set(k for k, v in out.items() if v == centre)
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_groups_equal_the_sequential_greedy_ones(spark, seed):
    data = random_prints(30, seed)
    f = fingerprints(spark, data)
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(data, 2) if tanimoto(x, y) >= 0.7]
    edges = spark.createDataFrame(pairs, "a string, b string")
    got = {r["name"]: r["centre"] for r in features.butina_groups(f, "name", edges).collect()}
    assert got == greedy([n for n, _ in data], pairs)
    assert sum(1 for _ in got) == 30


def test_components_match_a_direct_decomposition(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 6)) @ np.diag([5, 3, 1, 1, 1, 0]) + 2
    panel = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(30) for j in range(6)], "row_id int, gene string, value double")
    fitted = features.pca_fit(panel, 2)
    sd = m.std(axis=0)
    z = (m - m.mean(axis=0)) / np.where(sd > 0, sd, 1)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    want = vt[:2].T
    want = want * np.sign(want[np.abs(want).argmax(axis=0), [0, 1]])
    got = np.array([r["loading"] for r in fitted.orderBy("gene").collect()])
    assert np.allclose(got, want, atol=1e-8)
    scores = {(r["row_id"], r["component"]): r["score"] for r in features.pca_project(panel, fitted).collect()}
    assert np.allclose([[scores[i, c] for c in (0, 1)] for i in range(30)], z @ want, atol=1e-8)


CONDITIONS = "condition_id string, cell_line string, drug string, is_control boolean, dose double, unit string, depmap_id string"


def view(spark, data):
    drugs = spark.createDataFrame([("A", True, 1.0), ("B", False, None)], "drug string, featurizable boolean, MolWt double")
    groups = spark.createDataFrame([("A", 1, 1)], "drug string, cluster_id int, cluster_size int")
    cells = spark.createDataFrame([("L", "x", True, True, 0.5), ("M", None, False, False, None), ("N", "y", True, False, None)], "cell_line string, depmap_id string, depmap_available boolean, expression_available boolean, pc_1 double")
    return features.condition_features(spark.createDataFrame(data, CONDITIONS), drugs, groups, cells)


def test_gaps_in_order(spark):
    data = [("1", "L", "A ", False, 5.0, "uM", "x"), ("2", "L", "A", True, 0.0, "uM", "x"), ("3", "L", "B", False, 5.0, "uM", "x"), ("4", "L", "?", False, 5.0, "nM", "x"), ("5", "M", "A", False, 5.0, "uM", None), ("6", "N", "A", False, 5.0, "uM", "y")]
    v = view(spark, data)
    assert rows(v.select("condition_id", "feature_gap")) == [("1", None), ("2", "control"), ("3", "drug_not_featurizable"), ("4", "drug_not_featurizable"), ("5", "no_depmap"), ("6", "no_expression")]
    assert v.filter("condition_id = '2'").first()["log10_dose_um"] is None
    contracts.check_feature_gaps(v, ["MolWt", "pc_1", "log10_dose_um"])
    with pytest.raises(ContractError):
        contracts.check_feature_gaps(v.withColumn("pc_1", F.lit(None).cast("double")), ["pc_1"])
    with pytest.raises(Exception, match="unknown dose unit"):
        view(spark, [("1", "L", "A", False, 5.0, "kg", "x")]).collect()
    assert features.columns_with_prefix(v, "pc_", "dmg_") == ["pc_1"]


def test_cell_features_need_a_declared_gap(spark):
    lines = spark.createDataFrame([("L", "x"), ("M", "y")], "cell_line string, depmap_id string")
    scores = spark.createDataFrame([("x", "pc_1", 0.5)], "depmap_id string, feature string, value double")
    flags = spark.createDataFrame([("x", "hot_G", 2.0)], "depmap_id string, feature string, value double")
    with pytest.raises(ContractError):
        features.cell_features(lines, scores, flags, {}, {})
    out = features.cell_features(lines, scores, flags, {"M": "not profiled"}, {})
    assert rows(features.pivot_features(out, ["pc_1", "hot_G", "hot_H"])) == [("L", 0.5, 1.0, 0.0), ("M", 0.0, 0.0, 0.0)]
    by_proxy = features.cell_features(lines, scores, flags, {}, {"M": "x"}).filter("cell_line = 'M'").first()
    assert by_proxy["expression_available"] and by_proxy["expression_source"] == "x"


def test_frequencies_and_drivers(spark):
    panel = spark.createDataFrame([(1, "g", 1.0), (2, "g", 0.0), (1, "h", 0.0)], "row_id int, gene string, value double")
    assert rows(features.frequent_columns(panel, 0.5)) == [("g", 0.5)]
    t = spark.createDataFrame([("g", "L"), ("g", "L"), ("g", "K"), ("h", "L"), (None, "L")], "gene string, line string")
    assert rows(features.driver_genes(t, "gene", "line", 2)) == [("g", 2, "K,L")]
