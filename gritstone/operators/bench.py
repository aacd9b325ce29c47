"""Paired measurement of two texts, and statistics of the plans that ran."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gritstone.operators.equivalence import ParameterSet, bound
from gritstone.plans import catalyst

PHASES = ("search", "held_out", "baseline_calibration", "overhead")


@dataclass(frozen=True)
class PlanStats:
    """What a plan did. Spark keeps no buffer hits, so ``shared_hit_blocks`` stays None."""

    node_types: tuple[str, ...] = ()
    join_types: tuple[str, ...] = ()
    scan_types: tuple[str, ...] = ()
    rows_scanned: int = 0
    spilled_bytes: int = 0
    shuffle_bytes: int = 0
    has_seq_scan: bool = False
    has_hash_join: bool = False
    has_nested_loop: bool = False
    has_merge_join: bool = False
    has_sort: bool = False
    has_materialize: bool = False
    shared_hit_blocks: int | None = None


@dataclass(frozen=True)
class Measurement:
    """One text, run ``len(times_ms)`` times."""

    times_ms: tuple[float, ...]
    rows: int
    plan: PlanStats | None = None
    plan_json: str = "{}"

    @property
    def median_ms(self) -> float:
        return percentile(list(self.times_ms), 0.5)


@dataclass(frozen=True)
class Pair:
    """Baseline and candidate with the same values, and which of them ran first."""

    run_pair_id: str
    phase: str
    parameter_set_id: str
    order: str
    baseline: Measurement
    candidate: Measurement

    @property
    def improvement_pct(self) -> float:
        return improvement_pct(self.baseline.median_ms, self.candidate.median_ms)


def percentile(values: list[float], p: float) -> float:
    """Linear interpolation between closest ranks, on n - 1."""
    if not values:
        return 0.0
    s = sorted(values)
    at = p * (len(s) - 1)
    low = int(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def improvement_pct(baseline: float, candidate: float) -> float:
    return (baseline - candidate) / baseline * 100 if baseline > 0 else 0.0


def check_phase(phase: str) -> str:
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}")
    return phase


def plan_stats(df: DataFrame) -> PlanStats:
    """From the plan that ran; call it after an action on the same DataFrame."""
    nodes = catalyst.plan_nodes(df)
    names = [n["node"].removesuffix("Exec") for n in nodes]
    total = lambda key, kinds=None: sum(n["metrics"].get(key, 0) for n in nodes if kinds is None or n["node"].removesuffix("Exec") in kinds)
    scans = tuple(n for n in names if "Scan" in n)
    return PlanStats(
        tuple(dict.fromkeys(names)),
        tuple(n for n in names if n.endswith("Join") or n == "CartesianProduct"),
        scans,
        total("numOutputRows", {"FileSourceScan", "BatchScan", "InMemoryTableScan", "LocalTableScan", "RDDScan"}),
        total("spillSize"),
        total("shuffleBytesWritten"),
        any(n in ("FileSourceScan", "BatchScan") for n in names),
        any(n in ("BroadcastHashJoin", "ShuffledHashJoin") for n in names),
        any(n in ("BroadcastNestedLoopJoin", "CartesianProduct") for n in names),
        "SortMergeJoin" in names,
        any(n in ("Sort", "TakeOrderedAndProject") for n in names),
        any(n in ("InMemoryTableScan", "ReusedExchange") for n in names),
    )


def measure(spark: SparkSession, sql: str, values: ParameterSet, iterations: int = 1, plans: bool = False) -> Measurement:
    """Wall time of draining every row into a sink that keeps none; the plan is read off a separate run."""
    times = []
    for _ in range(max(iterations, 1)):
        df = bound(spark, sql, values)
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times.append((time.perf_counter() - began) * 1000)
    df = bound(spark, sql, values)
    rows = df.count()
    if not plans:
        return Measurement(tuple(times), rows)
    catalyst.run(df)
    return Measurement(tuple(times), rows, plan_stats(df), catalyst.plan_json(df))


Measure = Callable[[str, ParameterSet], Measurement]


def spark_measure(spark: SparkSession, iterations: int = 1, plans: bool = False) -> Measure:
    return lambda sql, values: measure(spark, sql, values, iterations, plans)


def run_pairs(run: Measure, baseline: str, candidate: str, sets: list[ParameterSet], phase: str, warm_up: bool = True, first: int = 1) -> list[Pair]:
    """One pair per set; odd pairs run the baseline first, even ones the candidate. Both sides are warmed up once."""
    check_phase(phase)
    if warm_up and sets:
        run(baseline, sets[0])
        run(candidate, sets[0])
    out = []
    for i, values in enumerate(sets, first):
        if i % 2:
            b = run(baseline, values)
            c = run(candidate, values)
        else:
            c = run(candidate, values)
            b = run(baseline, values)
        out.append(Pair(uuid.uuid4().hex, phase, values.parameter_set_id, "baseline_first" if i % 2 else "candidate_first", b, c))
    return out


def calibrate(run: Measure, baseline: str, sets: list[ParameterSet], warm_up: bool = True) -> list[tuple[str, Measurement]]:
    """The baseline alone, per set."""
    if warm_up and sets:
        run(baseline, sets[0])
    return [(s.parameter_set_id, run(baseline, s)) for s in sets]


@dataclass(frozen=True)
class BenchmarkRow:
    """A measurement as a row of the metadata store."""

    benchmark_id: str
    run_pair_id: str
    phase: str
    role: str
    template_id: str
    candidate_id: str | None
    parameter_set_id: str
    execution_order: str
    execution_times_ms: list[float] = field(default_factory=list)
    mean_ms: float = 0.0
    median_ms: float = 0.0
    p75_ms: float = 0.0
    p95_ms: float = 0.0
    row_count: int = 0
    plan_json: str = "{}"
    rows_scanned: int | None = None
    spilled_bytes: int | None = None


def benchmark_rows(pairs: list[Pair], template_id: str, candidate_id: str) -> list[dict]:
    out = []
    for p in pairs:
        for role, m in (("baseline", p.baseline), ("candidate", p.candidate)):
            t = list(m.times_ms)
            out.append(asdict(BenchmarkRow(uuid.uuid4().hex, p.run_pair_id, p.phase, role, template_id, candidate_id, p.parameter_set_id, p.order, t, sum(t) / len(t), m.median_ms, percentile(t, 0.75), percentile(t, 0.95), m.rows, m.plan_json, m.plan.rows_scanned if m.plan else None, m.plan.spilled_bytes if m.plan else None)))
    return out
