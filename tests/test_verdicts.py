"""The verdict rests on paired intervals and a second metric, not on the sign of a median."""

import numpy as np

from platewise.plans import screening


def test_a_gain_within_noise_is_no_success(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = []
    for split, gain, noise, mse in (("random", 0.0004, 0.05, -0.1), ("unseen_drug", 0.2, 0.01, -0.1), ("both_unseen", 0.2, 0.01, 0.1)):
        for i in range(40):
            d = gain + (i - 19.5) / 20 * noise
            base = float(rng.normal()) / 100
            data += [(0, split, f"c{i}", "ridge", base, 0.5), (0, split, f"c{i}", "neural", base + d, 0.5 + mse)]
    spark.createDataFrame(data, "repeat int, split string, condition_id string, model string, de_pearson double, de_mse double").write.parquet(str(tmp_path / "per_condition.parquet"))
    got = {r["split"]: r for r in screening.QUERIES["claim_verdicts"](spark, str(tmp_path)).collect()}
    assert {s: r["verdict"] for s, r in got.items()} == {"random": "FAILURE", "unseen_drug": "SUCCESS", "both_unseen": "FAILURE"}
    assert got["random"]["de_pearson"] > 0 > got["random"]["de_low"]
