import random

from kenmark.functions.generate import SCENARIOS, base, common, dataset, mutate, scenario_pairs, score_table
from kenmark.functions.registry import ScoringOptions
from kenmark.operators.evaluate import best_threshold, threshold_sweep, within_gate
from kenmark.operators.scoring import score_pairs


def test_seeds_decide():
    assert base(4) == base(4) != base(5)
    assert mutate(base(4), 0.0, 1) == base(4) and mutate(base(4), 1.0, 1)["canvas"] != base(4)["canvas"]
    assert common(1)["canvas"] is None and len(SCENARIOS) == 19
    assert all(change(start(1), random.Random(1)) for start, change, _, _ in SCENARIOS.values())


def test_scenarios_separate(spark):
    scored = score_pairs(scenario_pairs(spark, 6), "f", "g", ScoringOptions(tlsh_weight=0.0)).selectExpr("scenario", "same_device", "is_attractor", "composite as score")
    rows = scored.collect()
    assert len(rows) == 6 * 19
    best = best_threshold(threshold_sweep(scored)).first()
    assert best.f1 > 0.9 and within_gate(threshold_sweep(scored)) and not within_gate(threshold_sweep(scored), -1)
    assert not within_gate(threshold_sweep(scored.limit(0)))
    assert "vpn-activation" in score_table(scored)


def test_dataset(spark):
    rows = dataset(spark, 10, 3).collect()
    assert len(rows) == 30 and sum(r.is_attractor for r in rows) == 6
