"""Whether paired measurements justify replacing a query."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from gritstone.operators.bandit import reward
from gritstone.operators.bench import Pair, improvement_pct, percentile

BOOTSTRAP_SAMPLES, BOOTSTRAP_SEED = 2000, 8675309
#: Pairs up to which the test adds up the whole distribution, whose work grows with the cube of their number; beyond, it
#: integrates the distribution's transform. Parameter files hold 100 by default.
MOST_PAIRS = 1000
#: Numbers that a resampling step holds at once.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Gate:
    """Thresholds of promotion."""

    alpha: float = 0.05
    min_improvement_pct: float = 2.0
    max_cv: float = 0.3
    min_pairs: int = 10


@dataclass(frozen=True)
class Evaluation:
    """The verdict and what it rests on."""

    promoted: bool
    reason: str
    pairs: int = 0
    baseline_median_ms: float = 0.0
    candidate_median_ms: float = 0.0
    improvement_pct: float = 0.0
    p_value: float = 1.0
    cv: float = 0.0


def signed_ranks(differences: list[float], zero: float = 1e-12) -> list[tuple[float, int]]:
    """(average rank of the size, sign) of every difference that is not zero."""
    kept = sorted((d for d in differences if abs(d) > zero), key=abs)
    out, i = [], 0
    while i < len(kept):
        j = i
        while j + 1 < len(kept) and abs(abs(kept[j + 1]) - abs(kept[i])) <= zero:
            j += 1
        out += [((i + j) / 2 + 1, 1 if kept[k] > 0 else -1) for k in range(i, j + 1)]
        i = j + 1
    return out


def wilcoxon_p(differences: list[float]) -> float:
    """Exact one-sided signed-rank test: the chance of a positive rank sum at least this large, if signs are coins."""
    ranks = signed_ranks(differences)
    if not ranks:
        return 1.0
    doubled = [round(2 * r) for r, _ in ranks]  # average ranks are halves
    observed = sum(d for d, (_, s) in zip(doubled, ranks) if s > 0)
    if len(ranks) > MOST_PAIRS:
        return rank_sum_tail(np.array(doubled), observed)
    chance = np.zeros(sum(doubled) + 1)  # of each rank sum
    chance[0], end = 1.0, 1
    for d in doubled:  # no sum so far reaches ``end``
        moved, end = chance[:end] / 2, end + d
        chance[:end] /= 2
        chance[d:end] += moved
    return min(1.0, float(chance[observed:].sum()))


def rank_sum_tail(doubled: np.ndarray, observed: int) -> float:
    """The chance that the doubled ranks with heads add up to ``observed`` or more; absolute error below about 1e-12.

    With x half a unit below ``observed``, the chance is 1/2 + 1/(2 pi) * the integral over [0, pi] of
    sin(t * (sum / 2 - x)) / sin(t / 2) * prod cos(d * t / 2). The trapezoid rule errs only by chances a whole period
    away, so its step follows the deviation. The product is at most exp(-sum sin(d * t / 2)**2 / 2); one transform of the
    ranks' counts gives that sum on a grid finer than its waves, and steps where it is large are left out.
    """
    unit = int(np.gcd.reduce(doubled))
    rank, many = np.unique(doubled // unit, return_counts=True)
    total, x = int(rank @ many), -(-observed // unit) - 0.5
    spread = math.sqrt(float((rank.astype(float) ** 2) @ many)) / 2
    if abs(x - total / 2) > 10 * spread:
        return 0.0 if x > total / 2 else 1.0
    steps = min(int(40 * spread) + 8, total + 1)  # points of the rule over a whole period
    grid = 1 << (16 * int(rank[-1])).bit_length()
    counts = np.zeros(grid)
    counts[rank] = many
    # sum of sin(d * t / 2)**2 at t = 2 pi k / grid; near a zero it changes by a small part of itself in a cell
    decay = (many.sum() - np.fft.rfft(counts).real) / 2
    keep = decay < 120
    keep[1:] |= keep[:-1].copy()
    keep[:-1] |= keep[1:].copy()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    out = 0.0
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
        low, high = -(-a * steps // grid), min(-(-z * steps // grid), steps // 2 + 1)
        for at in range(low, high, step := max(1, BLOCK // len(rank))):
            k = np.arange(at, min(at + step, high))
            t = 2 * math.pi * k / steps
            wave = np.cos(np.multiply.outer(t, rank) / 2)
            with np.errstate(divide="ignore"):
                size = np.exp(np.log(np.abs(wave)) @ many)
            sign = 1 - 2 * (((wave < 0) @ many) % 2)
            half = np.sin(t / 2)
            part = np.where(k == 0, total - 2 * x, np.sin(t * (total / 2 - x)) / np.where(k == 0, 1, half)) * size * sign
            out += float((part * np.where((k == 0) | (2 * k == steps), 0.5, 1.0)).sum())
    return min(1.0, max(0.0, 0.5 + out / steps))


def rank_biserial(differences: list[float]) -> float:
    ranks = signed_ranks(differences)
    total = sum(r for r, _ in ranks)
    return sum(r * s for r, s in ranks) / total if total else 0.0


def coefficient_of_variation(values: list[float]) -> float:
    """Sample standard deviation over the mean; 0 for fewer than two values or a mean near 0."""
    if len(values) < 2:
        return 0.0
    mean = sum(values) / len(values)
    if abs(mean) < 1e-12:
        return 0.0
    return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) / abs(mean)


def bootstrap_interval(baseline: list[float], candidate: list[float], samples: int = BOOTSTRAP_SAMPLES, seed: int = BOOTSTRAP_SEED) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of the median improvement over resampled pairs."""
    n = len(baseline)
    if not n:
        return 0.0, 0.0
    rng, sides, step = np.random.default_rng(seed), [np.asarray(side, float) for side in (baseline, candidate)], max(1, BLOCK // n)
    medians = []
    for at in range(0, samples, step):  # the numbers drawn are those of one draw for all samples
        drawn = rng.integers(0, n, (min(step, samples - at), n))
        medians.append([np.median(side[drawn], axis=1) for side in sides])
    b, c = (np.concatenate(x) for x in zip(*medians))
    gains = np.divide(b - c, b, out=np.zeros_like(b), where=b > 0) * 100
    low, high = np.quantile(gains, [0.025, 0.975])
    return float(low), float(high)


def evaluate(pairs: list[Pair], gate: Gate = Gate()) -> Evaluation:
    """The gates, in order; the first that fails names the reason."""
    if not pairs:
        return Evaluation(False, "no_benchmark_pairs")
    base, cand = [p.baseline.median_ms for p in pairs], [p.candidate.median_ms for p in pairs]
    gain = improvement_pct(percentile(base, 0.5), percentile(cand, 0.5))
    rewards = [reward(b, c) for b, c in zip(base, cand)]
    told = {"pairs": len(pairs), "baseline_median_ms": percentile(base, 0.5), "candidate_median_ms": percentile(cand, 0.5), "improvement_pct": gain, "p_value": wilcoxon_p([b - c for b, c in zip(base, cand)]), "cv": coefficient_of_variation(rewards)}
    for failed, reason in (
        (len(pairs) < gate.min_pairs, "statistically_insufficient"),
        (gain < gate.min_improvement_pct, "improvement_below_threshold"),
        (told["cv"] > gate.max_cv, "candidate_relative_latency_unstable"),
        (told["p_value"] >= gate.alpha, "not_statistically_significant"),
    ):
        if failed:
            return Evaluation(False, reason, **told)
    return Evaluation(True, "paired_statistical_evidence", **told)
