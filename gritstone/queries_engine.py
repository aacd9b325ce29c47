"""Registered queries for the rewrite, validation and analysis operators.

Rewrites run as rewritten and are compared with the *original* text by the oracle. Records of runs have no input table:
they are made from the relational tables by portable SQL, defects included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import analytics
from gritstone.operators.equivalence import comparable, multiset_difference
from gritstone.operators.rules import RULES
from gritstone.plans import dialect
from gritstone.sources import store
from gritstone.sources.catalog import Catalog, tables_in, with_views
from gritstone.sources.templates import ALL, PREVIOUS_ROW_ORACLE, PREVIOUS_ROW_TEMPLATE

#: For each rule, a query that it rewrites.
REWRITTEN = {
    "predicate_redundant_elimination": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey > 10 AND l_partkey > 250 AND l_partkey < 900 AND l_partkey < 400",
    "boolean_simplification": "SELECT o_orderkey FROM orders WHERE TRUE AND o_orderstatus = 'F' AND o_orderkey > 50 AND (o_orderstatus = 'F')",
    "comparison_normalization": "SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 20)",
    "subquery_column_prune": "SELECT q.k, q.n FROM (SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_clerk) AS latest_clerk FROM orders GROUP BY o_custkey) q WHERE q.n > 3",
    "in_to_exists": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT ps_partkey FROM partsupp WHERE ps_supplycost > 600 OR ps_availqty < 2)",
    "not_in_to_not_exists": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "count_gt_zero_to_exists": "SELECT s_suppkey, s_name FROM supplier WHERE (SELECT COUNT(*) FROM partsupp WHERE ps_suppkey = s_suppkey AND ps_availqty > 150) > 0",
    "implicit_to_explicit_join": "SELECT c_name, o_orderkey, n_name FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND (o_orderstatus = 'F' OR n_name = 'NATION_3')",
    "implicit_to_explicit_join_alternate_order": "SELECT n_name, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_quantity > 40 GROUP BY n_name",
    "redundant_group_by_elimination": "SELECT k, n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) q GROUP BY k, n",
    "merge_scalar_aggregates": dialect.inline(ALL["rw_10"].sql, ALL["rw_10"].types, ALL["rw_10"].values),
    "distinct_join_to_exists": dialect.inline(ALL["rw_04"].sql, ALL["rw_04"].types, ALL["rw_04"].values),
    "or_to_union_all": dialect.inline(ALL["rw_06"].sql, ALL["rw_06"].types, ALL["rw_06"].values),
    "previous_row_join": PREVIOUS_ROW_TEMPLATE.sql.rpartition("WHERE")[0].strip(),
}


def rewritten(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rule's query, after the rule."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        used = tables_in(REWRITTEN[rule_id])
        catalog = Catalog(spark, sf).register(used)
        text = next(r for r in RULES if r.rule_id == rule_id).apply(REWRITTEN[rule_id], catalog.schema_context(used))
        if text is None:
            raise ValueError(f"{rule_id} does not apply to its query")
        return spark.sql(text)

    return run


RUNS = """SELECT 'p' || CAST(CAST(FLOOR(o_orderkey / 2.0) AS BIGINT) AS STRING) AS run_pair_id, o_orderkey % 2 = 0 AS is_baseline,
  CASE WHEN o_orderkey % 97 = 0 THEN 'other' ELSE 't' || CAST(CAST(FLOOR(o_orderkey / 2.0) AS BIGINT) % 7 AS STRING) END AS template_fingerprint,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 89 = 1 THEN '' ELSE 'c' || CAST(CAST(FLOOR(o_orderkey / 2.0) AS BIGINT) % 5 AS STRING) END AS candidate_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'overhead' WHEN CAST(FLOOR(o_orderkey / 2.0) AS BIGINT) % 10 < 7 THEN 'search' ELSE 'held_out' END AS benchmark_phase,
  's' || CAST(CAST(FLOOR(o_orderkey / 2.0) AS BIGINT) % 30 AS STRING) AS parameter_set_id,
  CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS DOUBLE) END AS median_execution_time,
  o_orderkey % 53 = 0 AS timed_out, CASE WHEN o_orderkey % 59 = 0 THEN 'failed' ELSE '' END AS error_message
  FROM orders"""
CANDIDATES = """SELECT 'c' || CAST(p_partkey AS STRING) AS id, 't' || CAST(p_partkey % 11 AS STRING) AS template_fingerprint, p_name AS sql_text,
  CASE WHEN p_partkey % 3 = 0 THEN 'llm' ELSE 'rule' END AS source_type, p_brand AS source_detail,
  CASE WHEN p_size % 4 = 0 THEN 'rejected' ELSE 'safe' END AS safety_status,
  CASE WHEN p_partkey % 5 = 0 THEN 'failed' WHEN p_partkey % 7 = 0 THEN 'unvalidated' ELSE 'validated' END AS semantic_status,
  CASE WHEN p_partkey % 173 = 1 THEN 'promoted' WHEN p_partkey % 17 = 0 THEN 'evicted' ELSE 'pool' END AS promotion_status,
  CASE WHEN p_partkey % 5 <> 0 THEN NULL WHEN p_size % 2 = 0 THEN 'row_multiset_mismatch' ELSE 'output_schema_mismatch' END AS rejection_reason,
  p_size AS benchmark_runs FROM part"""
CASES = """SELECT CASE WHEN c_custkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, c_mktsegment AS outcome, c_name AS workload_label,
  CASE WHEN c_custkey % 11 = 0 THEN 'exception' ELSE NULL END AS failure_reason, c_nationkey AS candidates_generated,
  c_nationkey % 5 AS candidates_returned, c_nationkey % 3 AS candidates_rejected, c_nationkey % 4 AS candidates_after_dedup,
  c_nationkey % 2 AS candidates_after_safety, c_nationkey % 6 AS benchmark_pairs, c_nationkey % 7 AS held_out_benchmark_pairs FROM customer"""
CHECKS = """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'full_comparison' ELSE 'hash_comparison' END AS method, s_suppkey % 5 <> 0 AS passed,
  CAST(s_nationkey AS BIGINT) AS rows_compared, CAST(s_suppkey % 40 AS DOUBLE) AS execution_time_ms FROM supplier"""
TEMPLATES = """SELECT 't' || CAST(n_nationkey AS STRING) AS template_fingerprint, n_name AS normalized_sql, CAST(n_regionkey AS BIGINT) AS execution_count,
  CAST(n_nationkey AS DOUBLE) AS avg_execution_time_ms, n_nationkey % 2 = 0 AS is_eligible FROM nation"""
BANDIT = """SELECT 'c' || CAST(p_partkey AS STRING) AS candidate_id, CAST(p_size AS DOUBLE) / 100 AS mean_reward, p_size AS total_pulls FROM part WHERE p_partkey % 2 = 0"""


def made(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    catalog = Catalog(spark, sf)
    for name in ("orders", "part", "customer", "supplier", "nation"):
        catalog.base(name).createOrReplaceTempView(name)
    return spark.sql(sql)


def difference(spark: SparkSession, sf: str) -> DataFrame:
    catalog = Catalog(spark, sf)
    line = catalog.base("lineitem").select("l_returnflag", "l_linestatus", "l_suppkey")
    a, b = line.filter("l_suppkey % 3 <> 0"), line.filter("l_suppkey % 3 <> 1")
    return multiset_difference(comparable(a, 0), comparable(b, 0)).select(F.col("_0").alias("l_returnflag"), F.col("_1").alias("l_linestatus"), F.col("_2").alias("l_suppkey"), F.col("in_original").cast("long").alias("in_original"), F.col("in_candidate").cast("long").alias("in_candidate"))


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda p: F.round(F.percentile("median_execution_time", F.lit(p)), 4)
    return made(spark, sf, RUNS).groupBy("template_fingerprint", "benchmark_phase").agg(at(0.5).alias("median_ms"), at(0.75).alias("p75_ms"), at(0.95).alias("p95_ms"), F.count("median_execution_time").alias("n"))


SUMMARY = ("template_fingerprint", "candidate_id", "benchmark_phase", "pair_count", "timeout_pair_count", "error_pair_count", "baseline_median_ms", "baseline_p75_ms", "baseline_p95_ms", "candidate_median_ms", "candidate_p75_ms", "candidate_p95_ms", "rank_biserial_correlation", "wilcoxon_nonzero_pairs", "mean_pair_improvement_pct", "pair_improvement_p25_pct", "pair_improvement_p75_pct", "paired_reward_cv", "median_improvement_pct", "improved_at_threshold")


def summary(spark: SparkSession, sf: str) -> DataFrame:
    # the bootstrap has no SQL; the exact test's p-value, which needs too many steps in SQL for groups of this size, is in promotion_gates
    found = analytics.template_summary(analytics.pair_integrity(made(spark, sf, RUNS)))
    found = found.withColumns({c: F.round(c, 4) for c in SUMMARY if c.endswith(("_ms", "_pct"))})
    return found.select(*SUMMARY).withColumns({c: F.round(c, 6) for c in ("rank_biserial_correlation", "paired_reward_cv")})


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return store.template_status(made(spark, sf, TEMPLATES), made(spark, sf, CANDIDATES), made(spark, sf, BANDIT)).withColumn("promoted_pulls", F.col("promoted_pulls").cast("double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_{r}": rewritten(r) for r in REWRITTEN} | {
    "equivalence_multiset_difference": difference,
    "bench_percentiles": percentiles,
    "pair_integrity": lambda spark, sf: analytics.pair_integrity(made(spark, sf, RUNS)).withColumn("signed_improvement_pct", F.round("signed_improvement_pct", 6)).withColumn("clipped_reward", F.round("clipped_reward", 6)),
    "template_summary": summary,
    "source_breakdown": lambda spark, sf: analytics.source_breakdown(made(spark, sf, CANDIDATES)).withColumn("valid_candidate_rate_pct", F.round("valid_candidate_rate_pct", 6)).withColumn("promotion_rate_pct", F.round("promotion_rate_pct", 6)),
    "outcome_rollup": lambda spark, sf: analytics.outcome_rollup(made(spark, sf, CASES)),
    "candidate_funnel": lambda spark, sf: analytics.candidate_funnel(made(spark, sf, CASES), made(spark, sf, TEMPLATES), made(spark, sf, CANDIDATES)),
    "equivalence_summary": lambda spark, sf: analytics.equivalence_summary(made(spark, sf, CHECKS)),
    "negative_outcomes": lambda spark, sf: analytics.negative_outcomes(made(spark, sf, CASES)).select("workload_label", "status", "outcome"),
    "template_status": _status,
    "pool_summary": lambda spark, sf: store.pool_summary(made(spark, sf, CANDIDATES)).withColumn("avg_benchmark_runs", F.round("avg_benchmark_runs", 6)),
}

_INTEGRITY = f"""runs AS ({RUNS}),
pairs AS (
  SELECT run_pair_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_baseline) AS nb, COUNT(*) FILTER (WHERE NOT is_baseline) AS nc,
    COUNT(DISTINCT benchmark_phase) AS np, COUNT(DISTINCT template_fingerprint) AS nt, COUNT(DISTINCT parameter_set_id) AS ns,
    MIN(benchmark_phase) AS benchmark_phase, MIN(template_fingerprint) AS template_fingerprint, MIN(parameter_set_id) AS parameter_set_id,
    MAX(candidate_id) FILTER (WHERE NOT is_baseline) AS candidate_id,
    MAX(median_execution_time) FILTER (WHERE is_baseline) AS b, MAX(median_execution_time) FILTER (WHERE NOT is_baseline) AS c,
    BOOL_OR(timed_out) AS timed_out, BOOL_OR(error_message <> '') AS failed
  FROM runs GROUP BY run_pair_id),
told AS (
  SELECT *, concat_ws(';', CASE WHEN n <> 2 THEN 'expected_two_rows' END, CASE WHEN nb <> 1 THEN 'expected_one_baseline' END,
    CASE WHEN nc <> 1 THEN 'expected_one_candidate' END, CASE WHEN np <> 1 THEN 'phase_mismatch' END,
    CASE WHEN nt <> 1 THEN 'template_mismatch' END, CASE WHEN ns <> 1 THEN 'parameter_set_mismatch' END,
    CASE WHEN coalesce(candidate_id, '') = '' THEN 'missing_candidate_id' END,
    CASE WHEN b IS NULL OR c IS NULL THEN 'missing_median_execution_time' END) AS integrity_issues FROM pairs)"""
ORACLES: dict[str, str] = {f"rule_{r}": with_views(sql) for r, sql in REWRITTEN.items()} | {
    "rule_previous_row_join": with_views(PREVIOUS_ROW_ORACLE, ["lineitem"]),
    "equivalence_multiset_difference": """SELECT l_returnflag, l_linestatus, l_suppkey, in_original, in_candidate FROM (
  SELECT l_returnflag, l_linestatus, l_suppkey, COUNT(*) FILTER (WHERE l_suppkey % 3 <> 0) AS in_original,
    COUNT(*) FILTER (WHERE l_suppkey % 3 <> 1) AS in_candidate FROM lineitem GROUP BY ALL) WHERE in_original <> in_candidate""",
    "bench_percentiles": f"""SELECT template_fingerprint, benchmark_phase, round(quantile_cont(median_execution_time, 0.5), 4) AS median_ms,
  round(quantile_cont(median_execution_time, 0.75), 4) AS p75_ms, round(quantile_cont(median_execution_time, 0.95), 4) AS p95_ms, COUNT(median_execution_time) AS n
FROM ({RUNS}) GROUP BY template_fingerprint, benchmark_phase""",
    "pair_integrity": f"""WITH {_INTEGRITY}
SELECT run_pair_id, template_fingerprint, candidate_id, benchmark_phase, parameter_set_id, b AS baseline_median_ms, c AS candidate_median_ms,
  timed_out, failed, CASE WHEN b > 0 AND c IS NOT NULL THEN round((b - c) / b * 100, 6) END AS signed_improvement_pct,
  CASE WHEN b > 0 AND c IS NOT NULL THEN round(greatest(0.0, (b - c) / b), 6) END AS clipped_reward,
  CASE WHEN integrity_issues = '' THEN 'valid' ELSE 'invalid' END AS integrity_status, integrity_issues FROM told""",
    "template_summary": f"""WITH {_INTEGRITY},
valid AS (SELECT *, abs(b - c) AS size FROM told WHERE integrity_issues = ''),
ranked AS (
  SELECT *, rank() OVER w + (COUNT(*) OVER (PARTITION BY template_fingerprint, candidate_id, benchmark_phase, size) - 1) / 2.0 AS r
  FROM valid WHERE size > 0 WINDOW w AS (PARTITION BY template_fingerprint, candidate_id, benchmark_phase ORDER BY size)),
signs AS (SELECT template_fingerprint, candidate_id, benchmark_phase, COUNT(*) AS k, SUM(r * sign(b - c)) / SUM(r) AS rb FROM ranked GROUP BY ALL)
SELECT v.template_fingerprint, v.candidate_id, v.benchmark_phase, COUNT(*) AS pair_count, COUNT(*) FILTER (WHERE timed_out) AS timeout_pair_count,
  COUNT(*) FILTER (WHERE failed) AS error_pair_count, round(quantile_cont(b, 0.5), 4) AS baseline_median_ms, round(quantile_cont(b, 0.75), 4) AS baseline_p75_ms,
  round(quantile_cont(b, 0.95), 4) AS baseline_p95_ms, round(quantile_cont(c, 0.5), 4) AS candidate_median_ms, round(quantile_cont(c, 0.75), 4) AS candidate_p75_ms,
  round(quantile_cont(c, 0.95), 4) AS candidate_p95_ms, round(coalesce(any_value(rb), 0), 6) AS rank_biserial_correlation, coalesce(any_value(k), 0) AS wilcoxon_nonzero_pairs,
  round(avg((b - c) / b * 100), 4) AS mean_pair_improvement_pct, round(quantile_cont((b - c) / b * 100, 0.25), 4) AS pair_improvement_p25_pct,
  round(quantile_cont((b - c) / b * 100, 0.75), 4) AS pair_improvement_p75_pct,
  round(CASE WHEN COUNT(*) < 2 OR avg(greatest(0.0, (b - c) / b)) < 1e-12 THEN 0 ELSE stddev_samp(greatest(0.0, (b - c) / b)) / avg(greatest(0.0, (b - c) / b)) END, 6) AS paired_reward_cv,
  round((quantile_cont(b, 0.5) - quantile_cont(c, 0.5)) / quantile_cont(b, 0.5) * 100, 4) AS median_improvement_pct,
  (quantile_cont(b, 0.5) - quantile_cont(c, 0.5)) / quantile_cont(b, 0.5) * 100 >= 2.0 AS improved_at_threshold
FROM valid v LEFT JOIN signs s ON s.template_fingerprint = v.template_fingerprint AND s.candidate_id = v.candidate_id AND s.benchmark_phase = v.benchmark_phase
GROUP BY v.template_fingerprint, v.candidate_id, v.benchmark_phase""",
    "source_breakdown": f"""SELECT source_type, source_detail, COUNT(*) AS candidates, COUNT(*) FILTER (WHERE safety_status = 'safe') AS safe,
  COUNT(*) FILTER (WHERE semantic_status = 'validated') AS validated, COUNT(*) FILTER (WHERE semantic_status = 'failed') AS failed,
  COUNT(*) FILTER (WHERE promotion_status = 'promoted') AS promoted, COUNT(rejection_reason) AS rejected_with_reason,
  coalesce(string_agg(DISTINCT rejection_reason, ';' ORDER BY rejection_reason), '') AS rejection_reasons,
  round(COUNT(*) FILTER (WHERE semantic_status = 'validated') / COUNT(*) * 100, 6) AS valid_candidate_rate_pct,
  round(COUNT(*) FILTER (WHERE promotion_status = 'promoted') / COUNT(*) * 100, 6) AS promotion_rate_pct
FROM ({CANDIDATES}) GROUP BY source_type, source_detail""",
    "outcome_rollup": f"""SELECT status, outcome, COUNT(*) AS cases, CAST(SUM(candidates_generated) AS BIGINT) AS candidates_generated,
  CAST(SUM(candidates_returned) AS BIGINT) AS candidates_returned, CAST(SUM(candidates_after_safety) AS BIGINT) AS candidates_after_safety,
  CAST(SUM(benchmark_pairs) AS BIGINT) AS benchmark_pairs, CAST(SUM(held_out_benchmark_pairs) AS BIGINT) AS held_out_benchmark_pairs,
  COUNT(failure_reason) AS failures FROM ({CASES}) GROUP BY status, outcome""",
    "candidate_funnel": f"""SELECT * FROM (SELECT COUNT(*) AS workload_case_rows, CAST(SUM(candidates_generated) AS BIGINT) AS cases_generated,
  CAST(SUM(candidates_returned) AS BIGINT) AS cases_returned, CAST(SUM(candidates_rejected) AS BIGINT) AS cases_rejected,
  CAST(SUM(candidates_after_dedup) AS BIGINT) AS cases_after_dedup, CAST(SUM(candidates_after_safety) AS BIGINT) AS cases_after_safety FROM ({CASES})),
  (SELECT COUNT(*) AS invocations FROM nation),
  (SELECT COUNT(*) AS candidates_recorded, COUNT(*) FILTER (WHERE safety_status = 'safe') AS candidates_safe,
  COUNT(*) FILTER (WHERE semantic_status = 'validated') AS candidates_validated, COUNT(*) FILTER (WHERE semantic_status = 'failed') AS candidates_semantic_failed,
  COUNT(*) FILTER (WHERE promotion_status = 'promoted') AS candidates_promoted, COUNT(rejection_reason) AS candidates_rejected_with_reason FROM ({CANDIDATES}))""",
    "equivalence_summary": f"""SELECT method, passed, COUNT(*) AS checks, CAST(SUM(rows_compared) AS BIGINT) AS rows_compared_total,
  round(quantile_cont(CAST(rows_compared AS DOUBLE), 0.5), 4) AS rows_compared_median, round(quantile_cont(execution_time_ms, 0.5), 4) AS execution_time_ms_median
FROM ({CHECKS}) GROUP BY method, passed""",
    "negative_outcomes": f"""SELECT workload_label, status, outcome FROM ({CASES})
WHERE outcome NOT IN ('promoted', 'held_out_completed') OR status <> 'completed' OR failure_reason IS NOT NULL""",
    "template_status": f"""SELECT t.template_fingerprint, t.normalized_sql, t.execution_count, t.avg_execution_time_ms AS baseline_avg_ms, t.is_eligible,
  c.id AS promoted_candidate_id, c.sql_text AS promoted_sql, c.source_type AS promoted_source, b.mean_reward AS promoted_reward, CAST(b.total_pulls AS DOUBLE) AS promoted_pulls
FROM ({TEMPLATES}) t LEFT JOIN ({CANDIDATES}) c ON c.template_fingerprint = t.template_fingerprint AND c.promotion_status = 'promoted'
LEFT JOIN ({BANDIT}) b ON b.candidate_id = c.id""",
    "pool_summary": f"""SELECT template_fingerprint, COUNT(*) AS total_candidates, COUNT(*) FILTER (WHERE semantic_status = 'validated') AS validated,
  COUNT(*) FILTER (WHERE semantic_status = 'failed') AS failed, COUNT(*) FILTER (WHERE promotion_status = 'promoted') AS promoted,
  COUNT(*) FILTER (WHERE source_type = 'rule') AS from_rules, COUNT(*) FILTER (WHERE source_type = 'llm') AS from_llm,
  round(AVG(benchmark_runs), 6) AS avg_benchmark_runs FROM ({CANDIDATES}) WHERE promotion_status <> 'evicted' GROUP BY template_fingerprint""",
}
