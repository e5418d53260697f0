"""Bootstrap settings of the registered queries, and intervals against plain resampling."""

import inspect

import numpy as np

from platewise.operators import stats
from platewise.plans import screening


def test_queries_draw_as_often_as_the_reference(spark, monkeypatch):
    asked = []
    usual = stats.bootstrap_intervals

    def note(*args, **kwargs):
        bound = inspect.signature(usual).bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments["resamples"])
        return usual(*args, **kwargs)

    monkeypatch.setattr(stats, "bootstrap_intervals", note)
    for name in ("bootstrap_ci", "paired_ci", "summary_documents"):
        screening.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(asked) == {2000} and len(asked) == 4


def test_intervals_are_those_of_plain_resampling(spark):
    rng = np.random.default_rng(5)
    groups = {("even", 0): rng.normal(size=50), ("even", 1): rng.normal(1, 2, size=31), ("odd", 0): rng.exponential(size=41), ("two", 0): np.array([0.0, 1.0])}
    data = [(r, s, float(v)) for (s, r), vs in groups.items() for v in vs]
    frame = stats.bootstrap_intervals(spark.createDataFrame(data, "repeat int, split string, v double"), ["split"], "v")
    assert "collect_list" not in frame._jdf.queryExecution().toString()
    got = {r["split"]: r for r in frame.collect()}
    for split in ("even", "odd", "two"):
        own = [v for (s, _), v in groups.items() if s == split]
        draws = np.mean([np.median(v[rng.integers(0, len(v), (40_000, len(v)))], axis=1) for v in own], axis=0)
        low, high = np.quantile(draws, [0.025, 0.975])
        assert abs(got[split]["estimate"] - np.mean([np.median(v) for v in own])) < 1e-12
        assert abs(got[split]["ci_low"] - low) < 0.15 * (high - low) and abs(got[split]["ci_high"] - high) < 0.15 * (high - low)


def test_exclusions_at_twenty_genes(spark):
    kept = {n: {r["reason"]: r["n"] for r in screening.QUERIES[n](spark, "/root/testdata/sf0.001").collect()} for n in ("scoring_exclusions", "scoring_exclusions_20")}
    assert sum(kept["scoring_exclusions"].values()) == sum(kept["scoring_exclusions_20"].values())
    assert kept["scoring_exclusions_20"].get("below_min_de_genes", 0) >= kept["scoring_exclusions"].get("below_min_de_genes", 0)
