"""Offline analysis of recorded runs, as DataFrames over the store's tables."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.measures import improvement_column, reward_column
from gritstone.operators.promotion import BOOTSTRAP_SAMPLES, BOOTSTRAP_SEED, bootstrap_interval, coefficient_of_variation, rank_biserial, signed_ranks, wilcoxon_p
from gritstone.session import ship_package
from gritstone.sources.files import write_csv


def require_single_run(rows: DataFrame, run_id: str | None = None) -> str:
    """The run that all rows belong to; ValueError for none, several, or another one."""
    found = [r[0] for r in rows.select("experiment_run_id").distinct().limit(2).collect()]
    if len(found) != 1 or run_id is not None and found[0] != run_id:
        raise ValueError(f"rows must belong to one run{f' ({run_id})' if run_id else ''}; found {found}")
    return found[0]


def pair_integrity(runs: DataFrame) -> DataFrame:
    """One row per measured pair, with everything that is wrong with it."""
    base, cand = F.col("is_baseline"), ~F.col("is_baseline")
    only = lambda side, c: F.first(F.when(side, F.col(c)), ignorenulls=True)
    g = runs.filter(F.coalesce(F.col("run_pair_id"), F.lit("")) != "").groupBy("run_pair_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(base).alias("n_baseline"),
        F.count_if(cand).alias("n_candidate"),
        F.count_distinct(F.coalesce("benchmark_phase", F.lit(""))).alias("n_phases"),
        F.count_distinct(F.coalesce("template_fingerprint", F.lit(""))).alias("n_templates"),
        F.count_distinct(F.coalesce("parameter_set_id", F.lit(""))).alias("n_sets"),
        F.min("benchmark_phase").alias("benchmark_phase"),
        F.min("template_fingerprint").alias("template_fingerprint"),
        F.min("parameter_set_id").alias("parameter_set_id"),
        only(cand, "candidate_id").alias("candidate_id"),
        only(base, "median_execution_time").alias("baseline_median_ms"),
        only(cand, "median_execution_time").alias("candidate_median_ms"),
        F.coalesce(F.bool_or(F.col("timed_out")), F.lit(False)).alias("timed_out"),
        F.coalesce(F.bool_or(F.coalesce(F.col("error_message"), F.lit("")) != ""), F.lit(False)).alias("failed"),
    )
    wrong = [
        (F.col("n_rows") != 2, "expected_two_rows"),
        (F.col("n_baseline") != 1, "expected_one_baseline"),
        (F.col("n_candidate") != 1, "expected_one_candidate"),
        (F.col("n_phases") != 1, "phase_mismatch"),
        (F.col("n_templates") != 1, "template_mismatch"),
        (F.col("n_sets") != 1, "parameter_set_mismatch"),
        (F.coalesce(F.col("candidate_id"), F.lit("")) == "", "missing_candidate_id"),
        (F.col("baseline_median_ms").isNull() | F.col("candidate_median_ms").isNull(), "missing_median_execution_time"),
    ]
    issues = F.concat_ws(";", *[F.when(c, F.lit(name)) for c, name in wrong])
    both = F.col("baseline_median_ms").isNotNull() & F.col("candidate_median_ms").isNotNull() & (F.col("baseline_median_ms") > 0)
    return g.select(
        "run_pair_id", "template_fingerprint", "candidate_id", "benchmark_phase", "parameter_set_id", "baseline_median_ms", "candidate_median_ms", "timed_out", "failed",
        F.when(both, improvement_column(F.col("baseline_median_ms"), F.col("candidate_median_ms"))).alias("signed_improvement_pct"),
        F.when(both, reward_column(F.col("baseline_median_ms"), F.col("candidate_median_ms"))).alias("clipped_reward"),
        F.when(issues == "", F.lit("valid")).otherwise(F.lit("invalid")).alias("integrity_status"),
        issues.alias("integrity_issues"),
    )


STATISTICS = "template_fingerprint string, candidate_id string, benchmark_phase string, wilcoxon_one_sided_p_value double, rank_biserial_correlation double, wilcoxon_nonzero_pairs bigint, paired_reward_cv double, bootstrap_low_pct double, bootstrap_high_pct double"


def _statistics(samples: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run_pair_id")
        b, c = rows["baseline_median_ms"].tolist(), rows["candidate_median_ms"].tolist()
        d = [x - y for x, y in zip(b, c)]
        low, high = bootstrap_interval(b, c, samples, seed)
        return pd.DataFrame([[*key, wilcoxon_p(d), rank_biserial(d), len(signed_ranks(d)), coefficient_of_variation(rows["clipped_reward"].tolist()), low, high]], columns=[x.split()[0] for x in STATISTICS.split(", ")])

    return run


def template_summary(pairs: DataFrame, min_improvement_pct: float = 2.0, alpha: float = 0.05, samples: int = BOOTSTRAP_SAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Per template, candidate and phase over valid pairs: percentiles in the JVM, exact tests per group.

    A group is one candidate's pairs in one phase, which the parameter files bound (100 by default); it is held by one
    task, whatever its size.
    """
    ship_package(pairs.sparkSession)
    keys = ["template_fingerprint", "candidate_id", "benchmark_phase"]
    valid = pairs.filter("integrity_status = 'valid'")
    at = lambda c, p: F.percentile(c, F.lit(p))
    basic = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.count_if(F.col("timed_out")).alias("timeout_pair_count"),
        F.count_if(F.col("failed")).alias("error_pair_count"),
        *[at(f"{side}_median_ms", p).alias(f"{side}_{name}_ms") for side in ("baseline", "candidate") for name, p in (("median", 0.5), ("p75", 0.75), ("p95", 0.95))],
        F.avg("signed_improvement_pct").alias("mean_pair_improvement_pct"),
        at("signed_improvement_pct", 0.25).alias("pair_improvement_p25_pct"),
        at("signed_improvement_pct", 0.75).alias("pair_improvement_p75_pct"),
    )
    tests = valid.groupBy(*keys).applyInPandas(_statistics(samples, seed), STATISTICS)
    gain = improvement_column(F.col("baseline_median_ms"), F.col("candidate_median_ms"))
    return basic.withColumn("median_improvement_pct", gain).join(tests, keys).withColumn("improved_at_threshold", F.col("median_improvement_pct") >= min_improvement_pct).withColumn("statistically_significant", F.col("wilcoxon_one_sided_p_value") < alpha).withColumn("reportable_positive_result", F.col("improved_at_threshold") & F.col("statistically_significant"))


def source_breakdown(candidates: DataFrame) -> DataFrame:
    reason = F.coalesce("rejection_reason", F.lit("")) != ""
    n = F.count(F.lit(1))
    return candidates.groupBy("source_type", "source_detail").agg(
        n.alias("candidates"),
        F.count_if(F.col("safety_status") == "safe").alias("safe"),
        F.count_if(F.col("semantic_status") == "validated").alias("validated"),
        F.count_if(F.col("semantic_status") == "failed").alias("failed"),
        F.count_if(F.col("promotion_status") == "promoted").alias("promoted"),
        F.count_if(reason).alias("rejected_with_reason"),
        F.array_join(F.array_sort(F.collect_set(F.when(reason, F.col("rejection_reason")))), ";").alias("rejection_reasons"),
        (F.count_if(F.col("semantic_status") == "validated") / n * 100.0).alias("valid_candidate_rate_pct"),
        (F.count_if(F.col("promotion_status") == "promoted") / n * 100.0).alias("promotion_rate_pct"),
    )


_COUNTED = ("candidates_generated", "candidates_returned", "candidates_after_safety", "benchmark_pairs", "held_out_benchmark_pairs")


def outcome_rollup(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _COUNTED], F.count_if(F.coalesce("failure_reason", F.lit("")) != "").alias("failures"))


def candidate_funnel(cases: DataFrame, invocations: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: how many candidates reached each stage."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    a = cases.agg(F.count(F.lit(1)).alias("workload_case_rows"), *[total(f"candidates_{c}").alias(f"cases_{c}") for c in ("generated", "returned", "rejected", "after_dedup", "after_safety")])
    b = invocations.agg(F.count(F.lit(1)).alias("invocations"))
    c = candidates.agg(
        F.count(F.lit(1)).alias("candidates_recorded"),
        F.count_if(F.col("safety_status") == "safe").alias("candidates_safe"),
        F.count_if(F.col("semantic_status") == "validated").alias("candidates_validated"),
        F.count_if(F.col("semantic_status") == "failed").alias("candidates_semantic_failed"),
        F.count_if(F.col("promotion_status") == "promoted").alias("candidates_promoted"),
        F.count_if(F.coalesce("rejection_reason", F.lit("")) != "").alias("candidates_rejected_with_reason"),
    )
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").join(c.withColumn("_k", F.lit(1)), "_k").drop("_k")


def equivalence_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("method", "passed").agg(F.count(F.lit(1)).alias("checks"), F.coalesce(F.sum("rows_compared"), F.lit(0)).cast("long").alias("rows_compared_total"), F.percentile("rows_compared", F.lit(0.5)).alias("rows_compared_median"), F.percentile("execution_time_ms", F.lit(0.5)).alias("execution_time_ms_median"))


def negative_outcomes(cases: DataFrame) -> DataFrame:
    """Cases that neither were promoted nor ended their held-out measurement, or that failed."""
    return cases.filter(~F.col("outcome").isin("promoted", "held_out_completed") | (F.col("status") != "completed") | (F.coalesce("failure_reason", F.lit("")) != ""))


def hypotheses(summary: DataFrame, cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the share of attempted workloads whose promoted candidate also gained on held-out values, and what data exist."""
    promoted = candidates.filter("promotion_status = 'promoted'").select(F.col("id").alias("candidate_id"))
    held = summary.filter("benchmark_phase = 'held_out'").join(promoted, "candidate_id", "left_semi").agg(F.count_if("reportable_positive_result").alias("h1_positive"), F.count(F.lit(1)).alias("held_out_summaries"))
    tried = cases.agg(F.count_distinct("workload_label").alias("attempted"), F.count_if(F.col("equivalence_passed")).alias("validated_cases"), F.count_if(F.col("benchmark_pairs") > 0).alias("measured_cases"))
    both = held.withColumn("_k", F.lit(1)).join(tried.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("h1_hit_rate_pct", F.when(F.col("attempted") > 0, F.col("h1_positive") / F.col("attempted") * 100.0))


def rate_per_second(samples: DataFrame, labels: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Counter samples as rates between neighbours of one label set; a counter that falls was reset and starts at 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(*labels).orderBy(ts)
    before, since = F.lag(value).over(w), F.lag(ts).over(w)
    risen = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    seconds = (F.unix_micros(ts) - F.unix_micros(since)) / 1e6
    return samples.withColumn("rate", F.when(since.isNotNull() & (seconds > 0), risen / seconds))


def window_totals(samples: DataFrame, label: str, every: str = "1 hour", ts: str = "ts", value: str = "value") -> DataFrame:
    """Per window and value of ``label``: samples, their sum, and the share of the window's sum over all labels."""
    each = samples.groupBy(F.window(ts, every)["start"].alias("window_start"), label).agg(F.count(F.lit(1)).alias("samples"), F.sum(value).alias("total"))
    whole = each.groupBy("window_start").agg(F.sum("total").alias("_whole"))
    return each.join(whole, "window_start").withColumn("share", F.when(F.col("_whole") != 0, F.col("total") / F.col("_whole"))).drop("_whole")


def write_reports(folder: str, pairs: DataFrame, summary: DataFrame, sources: DataFrame, funnel: DataFrame, outcomes: DataFrame) -> dict[str, Path]:
    """Three CSV tables, one JSON and one Markdown summary, in a local folder of the driver. Spark writes the pairs, of which
    there may be many; the summaries have a row for each candidate or source."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    made = {}
    made["pair-summary"] = out / "pair-summary.csv"
    write_csv(pairs.orderBy("run_pair_id"), made["pair-summary"].resolve().as_uri())
    frames = {"template-summary": summary.orderBy("template_fingerprint", "candidate_id", "benchmark_phase"), "source-summary": sources.orderBy("source_type", "source_detail")}
    tables = {name: df.toPandas() for name, df in frames.items()}
    for name, t in tables.items():
        made[name] = out / f"{name}.csv"
        t.to_csv(made[name], index=False)
    told = {"funnel": funnel.first().asDict(), "outcomes": [r.asDict() for r in outcomes.orderBy("status", "outcome").collect()], "templates": json.loads(tables["template-summary"].to_json(orient="records"))}
    made["json"] = out / "analysis.json"
    made["json"].write_text(json.dumps(told, indent=2, default=str))
    lines = ["# Run analysis", "", "| template | candidate | phase | pairs | baseline ms | candidate ms | gain % | p | reportable |", "|---|---|---|---|---|---|---|---|---|"]
    lines += [f"| {str(r.template_fingerprint)[:12]} | {str(r.candidate_id)[:12]} | {r.benchmark_phase} | {r.pair_count} | {r.baseline_median_ms:.2f} | {r.candidate_median_ms:.2f} | {r.median_improvement_pct:.2f} | {r.wilcoxon_one_sided_p_value:.6f} | {r.reportable_positive_result} |" for r in tables["template-summary"].itertuples()]
    made["markdown"] = out / "analysis.md"
    made["markdown"].write_text("\n".join(lines) + "\n")
    return made


def bundle(folder: str, target: str) -> tuple[Path, str]:
    """A zip of the folder and its SHA-256, also written beside it."""
    path = Path(target)

    def files() -> Iterator[Path]:
        return (f for f in sorted(Path(folder).rglob("*")) if f.is_file() and f.resolve() != path.resolve())

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files():
            z.write(f, f.relative_to(folder))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    path.with_name(path.name + ".sha256").write_text(f"{digest}  {path.name}\n")
    return path, digest
