import math

import numpy as np
import pytest

from platewise.operators import contracts, crosscheck, evaluation, exports, features, harness, ridge, stats
from platewise.operators.contracts import ContractError
from tests.conftest import rows

DE = "condition_id string, gene_symbol string, log2foldchange double, padj double, rank int"


def test_sets_take_the_smallest_padj_then_the_larger_change(spark):
    de = spark.createDataFrame(
        [("c", "A", 1.0, 0.01, 9), ("c", " B", -3.0, 0.01, 1), ("c", "C", 9.0, 0.04, 2), ("c", "D", 1.0, 0.05, 3), ("c", "E", 1.0, math.nan, 4), ("c", "F", None, 0.001, 5), ("c", "G", 1.0, None, 6), ("c", "A", 5.0, 0.02, 7), (None, "A", 1.0, 0.0, 1)], DE
    )
    assert sorted((r["rank"], r["gene_symbol"]) for r in evaluation.de_sets(de, most=2).collect()) == [(1, "B"), (2, "A")]
    assert evaluation.de_sets(de.limit(0)).count() == 0


def test_reasons_in_order(spark):
    view = spark.createDataFrame([("1", "L", True, True), ("2", "X", False, True), ("3", "L", False, False), ("4", "L", False, True), ("5", "L", False, True), ("6", "L", False, True)], "condition_id string, cell_line string, is_control boolean, features_complete boolean")
    sets = spark.createDataFrame([("5", "g"), ("6", "g"), ("6", "h")], "condition_id string, gene_symbol string")
    lines = spark.createDataFrame([("L",)], "cell_line string")
    got = rows(evaluation.scoring_reasons(view, lines, sets, 2))
    assert got == [("1", "control"), ("2", "ineligible_line"), ("3", "features_incomplete"), ("4", "no_de_set"), ("5", "below_min_de_genes"), ("6", None)]
    assert rows(evaluation.forbidden_test_lines(view, lines)) == [("L",), ("X",)]


def conditions(spark):
    return spark.createDataFrame([(f"c{i:03d}", f"L{i % 6}", i % 7 if i % 9 else None) for i in range(96)], "condition_id string, cell_line string, cluster int")


def test_splits_do_not_leak(spark):
    c = conditions(spark)
    s = evaluation.make_splits(c, 3).cache()
    contracts.check_splits(s.filter("split = 'unseen_drug'"), c, "cluster")
    contracts.check_splits(s.filter("split in ('unseen_cell_line')"), c, "cell_line")
    contracts.check_splits(s.filter("split = 'both_unseen'"), c, "cluster")
    contracts.check_splits(s.filter("split = 'both_unseen'"), c, "cell_line")
    demands = {"unseen_drug": ["cluster"], "unseen_cell_line": ["cell_line"], "both_unseen": ["cluster", "cell_line"]}
    contracts.check_named_splits(s, c, demands)
    with pytest.raises(ContractError):
        contracts.check_named_splits(s, c, {**demands, "random": ["cell_line"]})
    with pytest.raises(ContractError):
        contracts.check_named_splits(s.union(s.limit(1)), c, demands)
    with pytest.raises(ContractError):
        contracts.check_splits(s.filter("split = 'random'"), c, "cell_line")
    with pytest.raises(ContractError):
        contracts.check_splits(s.filter("split = 'unseen_cell_line'"), c, "cell_line", c.select("cell_line"))
    sizes = {(r["repeat"], r["split"]): (r["train"], r["val"], r["test"]) for r in evaluation.split_sizes(s, c).collect()}
    assert sizes[0, "random"] == (63, 14, 19)
    assert rows(s) == rows(evaluation.make_splits(c.repartition(7), 3))
    assert s.filter("split = 'unseen_drug'").join(c.filter("cluster is null"), "condition_id").count() == 0


def test_dense_targets_are_zero_where_nothing_is_known(spark):
    v = spark.createDataFrame([("a", "g", 1.5), ("a", "x", 9.0)], "condition_id string, gene_symbol string, y double")
    c = spark.createDataFrame([("a",), ("b",)], "condition_id string")
    assert rows(evaluation.dense_targets(v, c, ["f", "g"])) == [("a", [0.0, 1.5]), ("b", [0.0, 0.0])]


RUNS = "repeat int, split string, condition_id string, cell_line string, drug string, dose double, part string"


def world(spark):
    train = [(f"{line}{drug}{dose}", line, drug, float(dose)) for line in "LM" for drug in "AB" for dose in (1, 2)][:-1]
    test = [("t1", "L", "A", 1.0), ("t2", "M", "Z", 2.0), ("t3", "L", "A", 9.0)]
    runs = spark.createDataFrame([(0, "s", *x, "train") for x in train] + [(0, "s", *x, "test") for x in test], RUNS)
    return runs, spark.createDataFrame([(c, "g", 100.0 * (line == "M") + 10.0 * (drug == "B") + dose) for c, line, drug, dose in train], "condition_id string, gene_symbol string, y double")


def test_means_and_fallback(spark):
    runs, values = world(spark)

    def told(model):
        t, p = harness.predict(model, runs, values)
        return {r["condition_id"]: (r["gene_symbol"], r["predicted"], r["is_fallback"]) for r in t.join(p, [*harness.RUN, "source"], "left").collect()}

    # a dose that was never trained (t3) has no answer
    assert told("drug_mean") == {"t1": ("g", 51.0, False), "t2": ("g", pytest.approx((2 + 12 + 102) / 3), True)}
    assert told("cell_mean")["t2"] == ("g", 102.0, False)
    assert told("global_mean")["t1"] == ("g", 56.0, False)
    assert told("dummy") == {"t1": (None, None, False), "t2": (None, None, False)}
    none = harness.predict("drug_mean", runs.limit(0), values)
    assert none[0].count() == none[1].count() == 0


def test_text_similarity_against_brute_force(spark):
    from collections import Counter

    texts = {"a": "CCO", "b": "CCN=O", "c": "cc1", "d": "", "e": None, "f": "CCO"}
    grams = {k: Counter(t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)) for k, t in texts.items() if t}
    want = {(x, y): sum((grams[x] & grams[y]).values()) / sum((grams[x] | grams[y]).values()) for x in grams for y in grams}
    df = spark.createDataFrame(list(texts.items()), "drug string, text string")
    got = {(r["drug"], r["other"]): r["similarity"] for r in features.text_similarity(df, "drug", "text").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v}


def brute_ridge(x, y, dose, part, sets, alphas):
    """Dense: standardise, one SVD, residual on the dose's mean, penalty by the validation rows' median correlation (ties: larger), refit."""

    def fitted(rows):
        mu, sd = x[rows].mean(axis=0), x[rows].std(axis=0)
        keep = sd > 1e-12
        base = {d: y[rows][dose[rows] == d].mean(axis=0) for d in set(dose[rows])}
        u, s, vt = np.linalg.svd((x[rows][:, keep] - mu[keep]) / sd[keep], full_matrices=False)
        uty = u.T @ (y[rows] - np.array([base[d] for d in dose[rows]]))
        return lambda at, a: np.array([base[d] for d in dose[at]]) + ((x[at][:, keep] - mu[keep]) / sd[keep]) @ vt.T @ ((s / (s**2 + a))[:, None] * uty)

    first, val = fitted(part == "train"), part == "val"
    scores = [np.nanmedian([np.corrcoef(p[sets[i]], y[i][sets[i]])[0, 1] for p, i in zip(first(val, a), np.flatnonzero(val))]) for a in alphas]
    best = max(range(len(alphas)), key=lambda k: (round(scores[k], 12), k))
    return alphas[best], fitted(part != "test")(part == "test", alphas[best])


def test_ridge_against_dense_svd(spark):
    rng = np.random.default_rng(4)
    n, genes = 80, [f"g{j}" for j in range(12)]
    x = np.hstack([rng.normal(size=(n, 5)), np.full((n, 1), 3.0), rng.integers(0, 3, (n, 1))])
    dose = rng.integers(0, 2, n).astype(float)
    y = np.where(rng.random((n, 12)) < 0.8, x[:, :5] @ rng.normal(size=(5, 12)) + dose[:, None] * 2 + rng.normal(size=(n, 12)), 0.0)
    ids = [f"c{i:02d}" for i in range(n)]
    runs, want = [], {}
    sets = {i: np.sort(rng.permutation(12)[:8]) for i in range(n)}
    alphas = ridge.alpha_grid(-2, 4, 1)
    for repeat in (0, 1):
        part = np.array(["train", "train", "val", "test"])[rng.integers(0, 4, n)]
        runs += [(repeat, "s", ids[i], "L", "D", float(dose[i]), str(part[i])) for i in range(n)]
        alpha, p = brute_ridge(x, y, dose, part, sets, alphas)
        want[repeat] = alpha, {(ids[i], genes[j]): p[k, j] for k, i in enumerate(np.flatnonzero(part == "test")) for j in sets[i]}
    r = spark.createDataFrame(runs + [(0, "s", "no features", "L", "D", 1.0, "train")], RUNS).repartition(5)
    feats = spark.createDataFrame([(ids[i], x[i].tolist()) for i in range(n)], "condition_id string, x array<double>")
    values = spark.createDataFrame([(ids[i], genes[j], float(y[i, j])) for i in range(n) for j in range(12) if y[i, j]], "condition_id string, gene_symbol string, y double")
    de = spark.createDataFrame([(ids[i], genes[j]) for i, js in sets.items() for j in js], "condition_id string, gene_symbol string")
    fitted, chosen = ridge.train(r, feats, values, de, alphas)
    assert {c["repeat"]: c["alpha"] for c in chosen.collect()} == {k: v[0] for k, v in want.items()}
    asked = r.filter("part = 'test'").select(*harness.RUN, "condition_id").join(de, "condition_id").select(*harness.RUN, "condition_id", "gene_symbol")
    got = {k: {} for k in want}
    for a in ridge.predict(fitted, chosen, asked, r, feats).collect():
        got[a["repeat"]][a["condition_id"], a["gene_symbol"]] = a["predicted"]
    for k in want:
        assert got[k] == {g: pytest.approx(v, abs=1e-4) for g, v in want[k][1].items()}
    nothing = ridge.train(r.limit(0), feats, values, de, alphas)
    assert nothing[1].count() == 0 and ridge.predict(*nothing, asked.limit(0), r.limit(0), feats).count() == 0
    assert len(ridge.alpha_grid()) == 21


def test_bootstrap_of_constants_is_exact_and_repeatable(spark):
    data = [(r, "s", f"c{i}", float(r)) for r in (0, 1) for i in range(9)] + [(0, "s", "x", math.nan)]
    s = spark.createDataFrame(data, "repeat int, split string, condition_id string, v double")
    assert rows(stats.bootstrap_intervals(s, ["split"], "v", 100)) == [("s", 0.5, 0.5, 0.5)]
    noisy = spark.createDataFrame([(r, "s", f"c{i}", math.sin(i * 7 + r)) for r in (0, 1) for i in range(40)], s.schema)
    first = rows(stats.bootstrap_intervals(noisy, ["split"], "v", 200))
    assert first == rows(stats.bootstrap_intervals(noisy.repartition(5), ["split"], "v", 200))
    assert first[0][2] <= first[0][1] <= first[0][3] and first[0][2] < first[0][3]
    summary = stats.score_summary(s, "v").first()
    assert (summary["estimate"], summary["n_scored"], summary["n_nan"]) == (0.5, 18, 1)
    flagged = stats.with_no_difference(stats.bootstrap_intervals(noisy, ["split"], "v", 200)).first()
    assert flagged["no_detectable_difference"] == (flagged["ci_low"] <= 0 <= flagged["ci_high"])


def test_paired(spark):
    s = spark.createDataFrame([(0, "s", "c", "a", 3.0), (0, "s", "c", "b", 1.0), (0, "s", "d", "a", 1.0), (0, "s", "d", "b", math.nan)], "repeat int, split string, condition_id string, model string, v double")
    assert rows(stats.paired_differences(s, "a", "b", "v")) == [(0, "s", "c", 2.0)]
    v = spark.createDataFrame([(0.1, -0.2), (-0.1, -0.2), (0.1, 0.0)], "lo double, disc double")
    assert [r[0] for r in v.select(stats.verdict("lo", "disc")).collect()] == ["SUCCESS", "FAILURE", "FAILURE"]


def test_crosscheck(spark):
    ours = spark.createDataFrame([("c", g, float(i)) for i, g in enumerate("ABCD", 1)] + [("c", "E", 1.0), ("c", "E", 2.0)], "condition_id string, gene_symbol string, logfc double")
    theirs = spark.createDataFrame([("c", "A", 2.0, 0.01), ("c", "B", 4.0, 0.01), ("c", "C", -1.0, 0.01), ("c", "D", 9.0, 0.05), ("c", "E", 1.0, 0.01), ("c", "A", math.nan, 0.01), ("e", "A", 1.0, 0.01)], "condition_id string, gene_symbol string, log2foldchange double, padj double")
    assert rows(crosscheck.compare(ours, theirs)) == [("c", 3, 0, round(2 / 3, 9), -0.5), ("e", 0, 0, None, None)]
    d = crosscheck.distribution(crosscheck.compare(ours, theirs), 0.6).first()
    assert (d["n_conditions"], d["status"]) == (1, "PASS")
    pool = spark.createDataFrame([(f"c{i}",) for i in range(50)], "condition_id string")
    assert rows(crosscheck.sample_conditions(pool, 10, "s")) == rows(crosscheck.sample_conditions(pool.repartition(5), 10, "s"))
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "drug string")
    assert rows(crosscheck.name_match(names, spark.createDataFrame([("A",), ("A ",), (" B",)], "drug string"), "drug")) == [("A", "A"), ("B", " B"), ("C", None)]


def test_slices_are_matched_by_dose_and_conflicts_are_listed(spark):
    schema = "condition_id string, cell_line string, plate string, drug string, dose double, unit string"
    own = spark.createDataFrame([("a", "L", "p", "d", 0.05, "uM"), ("b", "L", "p", "d", 5.0, "uM"), ("c", "L", "p", "e", 1.0, "uM"), ("n", None, "p", "d", 0.05, "uM"), ("z", "L", "p", "d", None, None)], schema)
    theirs = spark.createDataFrame([("x", "L", "p", "d", 50.00000001, "nM"), ("y", "L", "p", "e", 1.0, "uM"), ("w", "L", "p", "e", 0.001, "mM"), ("v", "L", "p", "d", 0.051, "uM")], schema).withColumnRenamed("condition_id", "other_id")
    assert rows(crosscheck.match_slices(own, theirs)) == [("a", "x", 1), ("b", None, 0), ("c", None, 2), ("n", None, 0), ("z", None, 0)]
    de = spark.createDataFrame([("c", "G"), ("c", "H"), ("d", "G")], "condition_id string, gene_symbol string")
    crosscheck.check_one_row_per_gene(de)
    with pytest.raises(ContractError):
        crosscheck.check_one_row_per_gene(de.union(de.limit(1)))
    dictionary = spark.createDataFrame([(1, "G"), (2, "H"), (2, "I")], "gene int, gene_symbol string")
    logfc = spark.createDataFrame([("c", 1, 0.5), ("c", 2, -1.0), ("c", 9, 1.0), ("d", 1, 1.0)], "condition_id string, gene int, logfc double")
    assert rows(crosscheck.own_changes(logfc, dictionary, spark.createDataFrame([("c",)], "condition_id string"))) == [("c", "G", 0.5), ("c", "H", -1.0), ("c", "I", -1.0)]


def test_lookup_and_tolerance(spark):
    import json

    values = spark.createDataFrame([("c", "A", 0.125), ("c", "B", -0.5), ("c", "C", 0.1)], "condition_id string, gene_symbol string, y double")
    c = spark.createDataFrame([("c", "D x", "L", 0.5)], "condition_id string, drug string, cell_line string, dose double")
    found = exports.lookup_rows(values, c, 2)
    assert sorted((r["nth"], r["gene_symbol"], r["measured"]) for r in found.collect()) == [(1, "B", -50), (2, "A", 12)]
    doc = json.loads(exports.lookup_documents(found).first()["document"])
    assert doc["conditions"]["c"]["genes"] == ["B", "A"] and doc["drug"] == "D x"
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0001), ("y", 2.0), ("w", 1.0)], "k string, v double")
    assert sorted((r["k"], r["reason"]) for r in exports.compare_with_tolerance(a, b, ["k"], "v", 0.001).collect()) == [("w", "missing"), ("y", "differs"), ("z", "unexpected")]
    assert exports.markdown(b.limit(1)).startswith("| k | v |")


def test_summary_documents_come_back(spark, tmp_path):
    from platewise.sources import readers

    s = spark.createDataFrame([(r, "s", f"c{i}", "m", float(i)) for r in (0, 1) for i in range(5)] + [(0, "s", "x", "m", math.nan)], "repeat int, split string, condition_id string, model string, v double")
    stats.summary_documents(s, ["v"], 50).select("document").write.text(str(tmp_path / "out"))
    row = readers.read_summaries(spark, str(tmp_path / "out")).first()
    assert (row["model"], row["metric"], row["split"], row["estimate"], row["n_scored"], row["n_nan"], row["repeat_medians"]) == ("m", "v", "s", 2.0, 10, 1, [2.0, 2.0])


def test_candidates_and_slice(spark):
    view = spark.createDataFrame([("1", "L", False, True), ("2", "L", True, True), ("3", "L", False, False), ("4", "M", False, True), ("5", "L", False, True)], "condition_id string, cell_line string, is_control boolean, features_complete boolean")
    have = spark.createDataFrame([("1",), ("4",)], "condition_id string")
    assert rows(evaluation.de_candidates(view, spark.createDataFrame([("L",)], "cell_line string"), have)) == [("1", "L")]
    known = spark.createDataFrame([("L", "x")], "cell_line string, external_id string")
    none = spark.createDataFrame([], "cell_line string")
    with pytest.raises(ContractError):
        evaluation.require_slice(evaluation.slice_lines(view, known, none))
    listed = evaluation.slice_lines(view, known, spark.createDataFrame([("M",)], "cell_line string"))
    evaluation.require_slice(listed)
    assert rows(listed) == [("L", 4, "x", False, False), ("M", 1, None, True, False)]


def test_written_under_a_contract(spark, tmp_path):
    import os

    good, bad = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",), ("a",)], "k string")
    check = lambda t: contracts.require_unique(t, ["k"], "t")
    assert contracts.write_checked(good, str(tmp_path / "good"), check).count() == 2
    with pytest.raises(ContractError):
        contracts.write_checked(bad, str(tmp_path / "bad"), check)
    assert os.path.exists(tmp_path / "good") and not os.path.exists(tmp_path / "bad")
    assert rows(contracts.report(bad, "t", {"is_a": bad["k"] == "a", "null": bad["k"].isNull()})) == [("t", "is_a", 2, 2), ("t", "null", 2, 0)]
