"""Which candidate to measure next: arms with rewards, and two policies over them."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, replace

THOMPSON, UCB = "thompson", "ucb1"
OBSERVATION_VARIANCE = 0.1


@dataclass(frozen=True)
class Arm:
    """What is known of one candidate. Before the first pull the prior is mean 0.5, variance 1."""

    candidate_id: str
    created_at: int = 0
    pulls: int = 0
    total_reward: float = 0.0
    mean_reward: float = 0.0
    posterior_mean: float = 0.5
    posterior_variance: float = 1.0
    ucb_score: float = 0.0
    last_pulled_at: int | None = None


def reward(baseline_ms: float, candidate_ms: float) -> float:
    """The relative gain; a regression earns nothing."""
    return max(0.0, (baseline_ms - candidate_ms) / baseline_ms) if baseline_ms > 0 else 0.0


def ucb(arm: Arm, total: int, c: float = math.sqrt(2)) -> float:
    return math.inf if not arm.pulls else arm.mean_reward + c * math.sqrt(math.log(max(total, 1)) / arm.pulls)


def choose(arms: list[Arm], policy: str = THOMPSON, rng: random.Random | None = None, c: float = math.sqrt(2)) -> Arm:
    """An arm without pulls first, the oldest; else by policy, ties to the smaller id."""
    if not arms:
        raise ValueError("no arms")
    fresh = [a for a in arms if not a.pulls]
    if fresh:
        return min(fresh, key=lambda a: (a.created_at, a.candidate_id))
    if policy == UCB:
        total = sum(a.pulls for a in arms)
        return min(arms, key=lambda a: (-ucb(a, total, c), a.candidate_id))
    if policy != THOMPSON:
        raise ValueError(f"unknown policy {policy!r}")
    rng = rng or random.Random(12345)
    drawn = {a.candidate_id: rng.gauss(a.posterior_mean, math.sqrt(max(a.posterior_variance, 1e-6))) for a in sorted(arms, key=lambda a: a.candidate_id)}
    return min(arms, key=lambda a: (-drawn[a.candidate_id], a.candidate_id))


def update(arm: Arm, rewards: list[float], now: int, others_pulls: int = 0, variance: float = OBSERVATION_VARIANCE, c: float = math.sqrt(2)) -> Arm:
    """A batch of rewards: each counts as a pull, and their mean as one observation of the conjugate normal model."""
    if not rewards:
        return arm
    prior_mean, prior_variance = (arm.posterior_mean, arm.posterior_variance) if arm.pulls else (0.5, max(arm.posterior_variance, 1e-6))
    observed = sum(rewards) / len(rewards)
    posterior = 1 / (1 / prior_variance + 1 / variance)
    mean = posterior * (prior_mean / prior_variance + observed / variance)
    pulls, total = arm.pulls + len(rewards), arm.total_reward + sum(rewards)
    after = replace(arm, pulls=pulls, total_reward=total, mean_reward=total / pulls, posterior_mean=mean, posterior_variance=posterior, last_pulled_at=now)
    return replace(after, ucb_score=ucb(after, others_pulls + pulls, c))
