"""The metadata store: one Parquet table per kind of record, all under one sequence of commits.

A change writes the tables' next contents beside the present ones, and then one small file that names the folder of every
table, renamed to the next commit's number: all tables change in that one step or none does, and the rename fails if the
number exists, so of two writers one loses. Small control tables are rewritten whole, which Parquet without a table format
asks for.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The records' columns. Texts named *_json hold JSON.
SCHEMAS = {
    "query_templates": "template_fingerprint string, normalized_sql string, first_seen timestamp, last_seen timestamp, execution_count bigint, total_execution_time_ms double, avg_execution_time_ms double, is_eligible boolean, is_excluded boolean, current_candidate_id string, tables_referenced array<string>",
    "invocations": "id string, experiment_run_id string, template_fingerprint string, trigger_type string, model_name string, model_digest string, model_runtime_version string, prompt_template_version string, prompt_hash string, schema_snapshot_hash string, candidates_generated int, candidates_after_dedup int, candidates_after_safety int, llm_latency_ms double, rule_latency_ms double, started_at timestamp, completed_at timestamp",
    "candidates": "id string, template_fingerprint string, sql_text string, canonical_hash string, source_type string, source_detail string, applied_rules array<string>, schema_snapshot_hash string, invocation_id string, safety_status string, semantic_status string, promotion_status string, rejection_reason string, rejection_layer int, benchmark_runs int, parameter_mapping map<string,string>, same_optimized_plan boolean, created_at timestamp",
    "benchmark_runs": "id string, experiment_run_id string, candidate_id string, template_fingerprint string, benchmark_phase string, run_pair_id string, parameter_set_id string, execution_order int, execution_times_ms array<double>, mean_execution_time double, median_execution_time double, p75_execution_time double, p95_execution_time double, rows_returned bigint, rows_scanned bigint, temp_written_bytes bigint, plan_json string, signed_improvement_pct double, is_baseline boolean, warm_cache boolean, error_message string, timed_out boolean, run_at timestamp",
    "bandit_state": "candidate_id string, template_fingerprint string, strategy string, total_pulls int, total_reward double, mean_reward double, posterior_mean double, reward_variance double, ucb_score double, created_at bigint, last_pulled_at bigint",
    "decisions": "id string, template_fingerprint string, decision_type string, candidate_id string, reason string, baseline_median_ms double, candidate_median_ms double, improvement_pct double, p_value double, confidence_interval_json string, benchmark_summary_json string, decided_at timestamp",
    "equivalence_checks": "id string, candidate_id string, check_type string, passed boolean, method string, parameter_set_ids array<string>, checks_json string, original_row_count bigint, candidate_row_count bigint, rows_compared bigint, mismatch_json string, execution_time_ms double, checked_at timestamp",
    "workload_case_results": "id string, experiment_run_id string, workload_manifest_file string, workload_label string, workload_description string, query_file string, parameter_file string, held_out_parameter_file string, expected_candidate_source_detail string, template_fingerprint string, invocation_id string, candidate_id string, status string, outcome string, failure_stage string, failure_reason string, failure_detail string, search_parameter_sets int, held_out_parameter_sets int, candidates_generated int, candidates_returned int, candidates_rejected int, candidates_after_dedup int, candidates_after_safety int, equivalence_passed boolean, benchmark_pairs int, held_out_benchmark_pairs int, baseline_median_ms double, candidate_median_ms double, improvement_pct double, details_json string, started_at timestamp, completed_at timestamp",
}
KEYS = {"query_templates": ["template_fingerprint"], "candidates": ["template_fingerprint", "canonical_hash"], "bandit_state": ["candidate_id"]}


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def new_id() -> str:
    return uuid.uuid4().hex


class Store:
    """Tables of records under a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _commit(self) -> tuple[int, dict[str, str]]:
        """The newest commit's number and the folder of each table in it."""
        folder = self._path("commits")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        newest = max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0)
        if not newest:
            return 0, {}
        stream = fs.open(self._path(f"commits/v{newest}"))
        try:
            return newest, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(SCHEMAS[table])

    def table(self, table: str) -> DataFrame:
        place = self._commit()[1].get(table)
        if not place:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(f"{self.root}/{table}/{place}")

    def frame(self, table: str, rows: Iterable[dict]) -> DataFrame:
        names = self.schema(table).names
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], self.schema(table))

    def swap(self, **tables: DataFrame) -> None:
        """Make these the tables' contents, all in one rename."""
        last, places = self._commit()
        for table, rows in tables.items():
            places[table] = new_id()
            rows.select(*self.schema(table).names).coalesce(1).write.parquet(f"{self.root}/{table}/{places[table]}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder, draft = self._path("commits"), self._path(f"drafts/{new_id()}")
        fs = folder.getFileSystem(conf)
        fs.mkdirs(folder)
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(places).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(draft, self._path(f"commits/v{last + 1}"), none)

    def insert(self, table: str, rows: Iterable[dict]) -> None:
        rows = list(rows)
        if rows:
            self.swap(**{table: self.table(table).unionByName(self.frame(table, rows))})

    def upsert(self, table: str, rows: Iterable[dict]) -> None:
        """New rows take the place of those with equal keys."""
        rows = list(rows)
        if rows:
            new = self.frame(table, rows)
            kept = self.table(table).join(new.select(*KEYS[table]), KEYS[table], "left_anti")
            self.swap(**{table: kept.unionByName(new)})

    def insert_missing(self, table: str, rows: Iterable[dict]) -> None:
        """Rows whose keys are there already are left out."""
        rows = list(rows)
        if rows:
            new = self.frame(table, rows).join(self.table(table).select(*KEYS[table]), KEYS[table], "left_anti")
            self.swap(**{table: self.table(table).unionByName(new.select(*self.schema(table).names))})

    def changed(self, table: str, condition: F.Column, **values) -> DataFrame:
        """The table with new values where the condition holds."""
        now_ = self.table(table)
        return now_.select(*[F.when(condition, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in now_.schema.fields])

    def update(self, table: str, condition: F.Column, **values) -> None:
        self.swap(**{table: self.changed(table, condition, **values)})

    def arms(self, template: str) -> DataFrame:
        """Validated candidates of a template with their state, oldest first."""
        c = self.table("candidates").filter((F.col("template_fingerprint") == template) & (F.col("semantic_status") == "validated") & (F.col("promotion_status") != "evicted"))
        return c.join(self.table("bandit_state").drop("template_fingerprint", "created_at"), c["id"] == F.col("candidate_id")).orderBy("created_at", "id")

    def pairs(self) -> DataFrame:
        """Baseline and candidate of each measured pair, side by side."""
        runs = self.table("benchmark_runs")
        b, c = runs.filter("is_baseline").alias("b"), runs.filter("NOT is_baseline").alias("c")
        return b.join(c, F.col("b.run_pair_id") == F.col("c.run_pair_id")).select("b.run_pair_id", "b.template_fingerprint", "c.candidate_id", "b.benchmark_phase", "b.parameter_set_id", F.col("b.median_execution_time").alias("baseline_median_ms"), F.col("c.median_execution_time").alias("candidate_median_ms"))

    def promote(self, template: str, candidate: str, decision: dict) -> None:
        """Demote the previous one to the pool, promote this one if it is validated, point the template at it, and record why:
        all in one commit."""
        found = self.table("candidates").filter(F.col("id") == candidate).select("semantic_status", "template_fingerprint").first()
        if found is None or found["semantic_status"] != "validated" or found["template_fingerprint"] != template:
            raise ValueError("only a validated candidate of the template can be promoted")
        mine = F.col("template_fingerprint") == template
        status = F.when(mine & (F.col("id") == candidate), F.lit("promoted")).when(mine & (F.col("promotion_status") == "promoted"), F.lit("pool")).otherwise(F.col("promotion_status"))
        made = self.frame("decisions", [{"id": new_id(), "template_fingerprint": template, "decision_type": "promote", "candidate_id": candidate, "decided_at": now()} | decision])
        self.swap(
            candidates=self.table("candidates").withColumn("promotion_status", status),
            query_templates=self.changed("query_templates", mine, current_candidate_id=candidate),
            decisions=self.table("decisions").unionByName(made),
        )


def template_status(templates: DataFrame, candidates: DataFrame, bandit: DataFrame) -> DataFrame:
    """Each template with its promoted candidate, if it has one."""
    promoted = candidates.filter("promotion_status = 'promoted'").select("template_fingerprint", F.col("id").alias("promoted_candidate_id"), F.col("sql_text").alias("promoted_sql"), F.col("source_type").alias("promoted_source"))
    state = bandit.select(F.col("candidate_id").alias("promoted_candidate_id"), F.col("mean_reward").alias("promoted_reward"), F.col("total_pulls").alias("promoted_pulls"))
    head = templates.select("template_fingerprint", "normalized_sql", "execution_count", F.col("avg_execution_time_ms").alias("baseline_avg_ms"), "is_eligible")
    return head.join(promoted, "template_fingerprint", "left").join(state, "promoted_candidate_id", "left").select(*head.columns, "promoted_candidate_id", "promoted_sql", "promoted_source", "promoted_reward", "promoted_pulls")


def pool_summary(candidates: DataFrame) -> DataFrame:
    """Counts per template over candidates that were not evicted."""
    having = lambda column, value: F.count_if(F.col(column) == value)
    return candidates.filter("promotion_status <> 'evicted'").groupBy("template_fingerprint").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        having("semantic_status", "validated").alias("validated"),
        having("semantic_status", "failed").alias("failed"),
        having("promotion_status", "promoted").alias("promoted"),
        having("source_type", "rule").alias("from_rules"),
        having("source_type", "llm").alias("from_llm"),
        F.avg("benchmark_runs").alias("avg_benchmark_runs"),
    )


def export_run(store: Store, run_id: str, folder: str) -> dict[str, DataFrame]:
    """The records of one run, each table a CSV folder with a header; nested columns as JSON."""
    of = F.col("experiment_run_id") == run_id
    cases, invocations, runs = store.table("workload_case_results").filter(of), store.table("invocations").filter(of), store.table("benchmark_runs").filter(of)
    templates = cases.select("template_fingerprint").union(invocations.select("template_fingerprint")).union(runs.select("template_fingerprint")).distinct()
    candidates = store.table("candidates").join(invocations.select(F.col("id").alias("invocation_id")), "invocation_id", "left_semi")
    named = candidates.select(F.col("id").alias("candidate_id"))
    out = {
        "workload_case_results": cases.orderBy("started_at", "workload_label"),
        "invocations": invocations.orderBy("started_at"),
        "benchmark_runs": runs.orderBy("run_at", "run_pair_id", "execution_order"),
        "query_templates": store.table("query_templates").join(templates, "template_fingerprint", "left_semi").orderBy("template_fingerprint"),
        "candidates": candidates.orderBy("template_fingerprint", "created_at", "id"),
        "bandit_state": store.table("bandit_state").join(named, "candidate_id", "left_semi").orderBy("candidate_id"),
        "decisions": store.table("decisions").join(named, "candidate_id", "left_semi").orderBy("decided_at"),
        "equivalence_checks": store.table("equivalence_checks").join(named, "candidate_id", "left_semi").orderBy("checked_at"),
    }
    for name, df in out.items():
        flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])
        flat.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return out
