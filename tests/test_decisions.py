"""Bandit, statistics and promotion: golden values and hand cases."""

import math
import random
from itertools import product

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gritstone.operators import promotion
from gritstone.operators.bandit import UCB, Arm, choose, reward, update
from gritstone.operators.bench import Measurement, Pair, check_phase, improvement_pct, percentile, run_pairs
from gritstone.operators.equivalence import ParameterSet
from gritstone.operators.promotion import Gate, bootstrap_interval, coefficient_of_variation, evaluate, rank_biserial, wilcoxon_p


def pair(b, c, i=0):
    return Pair(f"p{i}", "search", f"s{i}", "baseline_first", Measurement((b,), 1), Measurement((c,), 1))


def test_rewards():
    assert reward(100, 125) == 0 and reward(100, 75) == 0.25 and reward(0, 5) == 0


def test_posterior():
    arm = update(Arm("a"), [0.2, 0.1], 1)
    assert arm.pulls == 2 and math.isclose(arm.total_reward, 0.3) and 0.15 < arm.posterior_mean < 0.5 and arm.posterior_variance < 1
    assert math.isclose(arm.posterior_variance, 1 / 11) and math.isclose(arm.posterior_mean, 2 / 11)
    assert update(arm, [], 2) == arm


def test_choice():
    used = [Arm("a", 0, 10, 3.0, 0.30), Arm("b", 1, 1, 0.1, 0.10)]
    assert choose(used, UCB).candidate_id == "b"
    assert choose([*used, Arm("d", 5), Arm("c", 4)]).candidate_id == "c"
    drawn = [choose([Arm("a", 0, 9, 0, 0, 0.9, 1e-9), Arm("b", 1, 9, 0, 0, 0.1, 1e-9)], rng=random.Random(i)).candidate_id for i in range(20)]
    assert set(drawn) == {"a"}
    with pytest.raises(ValueError):
        choose([])


def test_percentiles():
    assert percentile([1, 2, 3, 4], 0.5) == 2.5 and percentile([10], 0.95) == 10 and percentile([], 0.5) == 0
    assert improvement_pct(200, 150) == 25 and improvement_pct(0, 5) == 0


@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9))
def test_wilcoxon_is_exact(values):
    kept = [v for v in values if v]
    order = sorted(abs(v) for v in kept)
    ranks = [order.index(abs(v)) + 1 + (order.count(abs(v)) - 1) / 2 for v in kept]
    seen = sum(r for r, v in zip(ranks, kept) if v > 0)
    ways = [sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=len(kept))]
    want = sum(w >= seen - 1e-9 for w in ways) / len(ways) if kept else 1.0
    assert math.isclose(wilcoxon_p([float(v) for v in values]), want)


@pytest.mark.parametrize("values,shift", [(2, 0.0), (7, 0.05), (10**7, 0.02), (10**7, -0.3), (3, 1.0)])
def test_signed_ranks_of_any_number_of_pairs(values, shift):
    """The transform's integral against the whole distribution, and groups beyond it."""
    rng = random.Random(values)
    drawn = [float(rng.randint(1, values) * (1 if rng.random() < 0.5 + shift / 2 else -1)) for _ in range(promotion.MOST_PAIRS + 1)]
    ranks = promotion.signed_ranks(drawn[:200])
    observed = sum(round(2 * r) for r, s in ranks if s > 0)
    assert math.isclose(promotion.rank_sum_tail(np.array([round(2 * r) for r, _ in ranks]), observed), wilcoxon_p(drawn[:200]), abs_tol=1e-12)
    more = wilcoxon_p(drawn)  # near enough to the normal distribution, with a half unit's correction
    ranks = promotion.signed_ranks(drawn)
    over = sum(r * s for r, s in ranks) / 2 - 0.25
    assert math.isclose(more, math.erfc(over / math.sqrt(sum(r * r for r, _ in ranks) / 2)) / 2, abs_tol=2e-2)


def test_bootstrap_draws_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    base, cand = [[rng.random() for _ in range(301)] for _ in range(2)]
    whole = bootstrap_interval(base, cand)
    monkeypatch.setattr(promotion, "BLOCK", 301 * 7)
    assert bootstrap_interval(base, cand) == whole


def test_effect_sizes():
    assert rank_biserial([1, 2, 3]) == 1 and rank_biserial([-1, -2]) == -1 and rank_biserial([0]) == 0
    assert coefficient_of_variation([1]) == 0 and coefficient_of_variation([0, 0]) == 0 and math.isclose(coefficient_of_variation([1, 3]), math.sqrt(2) / 2)
    low, high = bootstrap_interval([100.0] * 10, [50.0] * 10, 200)
    assert low == high == 50 and bootstrap_interval([100.0, 90, 95], [60, 70, 65.0], 100) == bootstrap_interval([100.0, 90, 95], [60, 70, 65.0], 100)


def test_gates_in_order():
    steady = [pair(100 + i, 70 + i, i) for i in range(12)]
    assert evaluate([]).reason == "no_benchmark_pairs"
    assert evaluate(steady[:5]).reason == "statistically_insufficient"
    assert evaluate([pair(100, 99.5, i) for i in range(12)]).reason == "improvement_below_threshold"
    assert evaluate([pair(100, 20 if i % 2 else 99, i) for i in range(12)]).reason == "candidate_relative_latency_unstable"
    noisy = [pair(100, 90, i) if i < 7 else pair(90, 100, i) for i in range(12)]
    assert evaluate(noisy, Gate(max_cv=9)).reason == "not_statistically_significant"
    good = evaluate(steady)
    assert good.promoted and good.reason == "paired_statistical_evidence" and good.p_value == 1 / 2**12


def test_pairs_alternate():
    seen = []

    def run(sql, values):
        seen.append((sql, values.parameter_set_id))
        return Measurement((1.0,), 1)

    made = run_pairs(run, "b", "c", [ParameterSet("1"), ParameterSet("2"), ParameterSet("3")], "search")
    assert [s for s, _ in seen] == ["b", "c", "b", "c", "c", "b", "b", "c"]
    assert [p.order for p in made] == ["baseline_first", "candidate_first", "baseline_first"]
    with pytest.raises(ValueError):
        check_phase("warm")
