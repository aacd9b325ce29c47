"""Equivalence checks, plans, store, analytics, workloads, and the runner's outcomes."""

import json
from collections import defaultdict
from dataclasses import asdict

import pytest

from gritstone.operators import analytics, bench
from gritstone.operators.equivalence import ParameterSet, preflight, validate
from gritstone.operators.proposer import OfflineProposer
from gritstone.operators.promotion import Gate
from gritstone.operators.runner import Options, Runner
from gritstone.plans import catalyst
from gritstone.sources import files, workloads
from gritstone.sources.catalog import Catalog
from gritstone.sources.store import Store, export_run, now, pool_summary, template_status
from gritstone.sources.templates import PREVIOUS_ROW_TEMPLATE

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def context(spark):
    return Catalog(spark, DATA).register().schema_context()


P = [ParameterSet("p")]


def test_equivalence(spark):
    spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'b'), (2, NULL) AS t(x, y)").createOrReplaceTempView("eq")
    ok = lambda a, b, **k: validate(spark, a, b, P, **k)
    assert ok("SELECT x, y FROM eq", "SELECT x, y FROM eq ORDER BY y").passed
    assert ok("SELECT x, y FROM eq ORDER BY x", "SELECT x, y FROM eq ORDER BY x, y DESC").passed  # ties may come in any order
    assert ok("SELECT x, y FROM eq ORDER BY x", "SELECT x, y FROM eq ORDER BY x DESC").reason == "ordered_rows_mismatch"
    wrong = ok("SELECT x FROM eq", "SELECT 1 AS x FROM eq")
    assert wrong.reason == "row_multiset_mismatch" and wrong.checks[0].detail["examples"]
    assert ok("SELECT x FROM eq", "SELECT CAST(x AS BIGINT) AS x FROM eq").reason == "output_schema_mismatch"
    assert ok("SELECT x FROM eq", "SELECT x FROM eq", most_rows=2).reason == "max_rows_full_compare_exceeded"
    assert ok("SELECT x FROM eq", "SELECT z FROM eq").reason == "query_execution_error"
    assert ok("SELECT 1.0D / 3 AS v", "SELECT 1.0D / 3 + 1e-15 AS v").passed
    assert validate(spark, "SELECT 1 AS a", "SELECT 1 AS a", []).reason == "no_parameter_sets"
    values = [ParameterSet("a", (("$1", "integer", 1),)), ParameterSet("b", (("$1", "integer", 2),))]
    assert validate(spark, "SELECT x FROM eq WHERE x = $1", "SELECT $1 AS x FROM eq WHERE x = $1", values).passed
    assert not validate(spark, "SELECT x FROM eq WHERE x = $1", "SELECT 1 AS x FROM eq WHERE x = $1", values).passed
    assert preflight(spark, "SELECT x FROM eq", "SELECT nope FROM eq", P)[0].detail["side"] == "candidate" and not preflight(spark, "SELECT x FROM eq", "SELECT y FROM eq", P)


def test_timeout(spark):
    slow = "SELECT COUNT(*) AS n FROM range(100000) a JOIN range(1000000) b ON a.id + b.id < 0"
    assert validate(spark, slow, slow, P, timeout_s=2).checks[0].detail["type"] == "TimeoutError"


def test_plans(spark, context):
    one = spark.sql("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
    two = spark.sql("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
    assert catalyst.optimized_fingerprint(one) == catalyst.optimized_fingerprint(two)
    m = bench.measure(spark, "SELECT o_custkey, COUNT(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey ORDER BY n", P[0], plans=True)
    assert m.rows > 0 and m.plan.has_seq_scan and m.plan.rows_scanned > 1000 and m.plan.has_sort and (m.plan.has_hash_join or m.plan.has_merge_join) and json.loads(m.plan_json)


def test_workloads(tmp_path, spark):
    a, b = workloads.write_tpch(tmp_path / "a"), workloads.write_tpch(tmp_path / "b")
    assert len(a) == len(b) == 22 * 3 + 5 and [f.read_bytes() for f in a] == [f.read_bytes() for f in b]
    search = workloads.read_parameter_sets(tmp_path / "a/parameters/tpch_q03.search.json")
    held = workloads.read_parameter_sets(tmp_path / "a/parameters/tpch_q03.held-out.json")
    assert (len(search), len(held)) == (70, 30) and not {s.parameter_set_id for s in search} & {s.parameter_set_id for s in held}
    assert not {s.parameters for s in search} & {s.parameters for s in held}
    assert len(workloads.write_anti_patterns(tmp_path / "r")) == 10 * 3 + 5
    manifest = workloads.read_manifest(tmp_path / "a/tpch-mixed.json")
    assert len(manifest) == 22 and manifest[0].expected_candidate_source_detail == "candidate-pool" and len(workloads.reduce_manifest(manifest, 3)) == 3
    (tmp_path / "q").mkdir()
    for name in ("10a", "2b", "schema"):
        (tmp_path / f"q/{name}.sql").write_text("SELECT MIN(a) AS a FROM t")
    workloads.write_join_order(tmp_path / "j", tmp_path / "q")
    assert [e.workload_label for e in workloads.read_manifest(tmp_path / "j/job-imdb-rule.json")] == ["job_imdb_2b_fixed_literal", "job_imdb_10a_fixed_literal"]
    with pytest.raises(ValueError):
        workloads.write_join_order(tmp_path / "j", tmp_path / "q", {"9z"})
    assert files.scan_manifest(spark, str(tmp_path / "a/tpch-rule.json")).count() == 22
    assert files.scan_parameter_sets(spark, str(tmp_path / "a/parameters/tpch_q03.search.json")).count() == 70
    (tmp_path / "t.csv").write_text('1,"a \\"b\\", c",\n2,,x\n')
    rows = files.scan_csv(spark, str(tmp_path / "t.csv"), "id int, s string, u string").orderBy("id").collect()
    assert rows[0].s == 'a "b", c' and rows[0].u is None and rows[1].s is None


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    base = {"template_fingerprint": "t", "source_type": "rule", "source_detail": "rule:x", "safety_status": "safe", "semantic_status": "validated", "promotion_status": "pool", "benchmark_runs": 2, "created_at": now()}
    store.upsert("query_templates", [{"template_fingerprint": "t", "normalized_sql": "SELECT 1", "execution_count": 1}])
    store.upsert("query_templates", [{"template_fingerprint": "t", "normalized_sql": "SELECT 2", "execution_count": 2}])
    assert [r.normalized_sql for r in store.table("query_templates").collect()] == ["SELECT 2"]
    store.upsert("candidates", [base | {"id": "a", "canonical_hash": "1", "promotion_status": "promoted"}, base | {"id": "b", "canonical_hash": "2"}, base | {"id": "c", "canonical_hash": "3", "semantic_status": "failed"}])
    store.insert_missing("bandit_state", [{"candidate_id": "b", "template_fingerprint": "t", "total_pulls": 0}])
    store.insert_missing("bandit_state", [{"candidate_id": "b", "template_fingerprint": "t", "total_pulls": 9}])
    assert [(r.id, r.total_pulls) for r in store.arms("t").collect()] == [("b", 0)]
    store.promote("t", "b", {"reason": "r"})
    assert {r.id: r.promotion_status for r in store.table("candidates").collect()} == {"a": "pool", "b": "promoted", "c": "pool"}
    with pytest.raises(ValueError):
        store.promote("t", "c", {"reason": "r"})
    status = template_status(store.table("query_templates"), store.table("candidates"), store.table("bandit_state")).collect()
    assert [(r.promoted_candidate_id, r.promoted_pulls) for r in status] == [("b", 0)] and store.table("query_templates").first().current_candidate_id == "b"
    assert pool_summary(store.table("candidates")).first().asDict() == {"template_fingerprint": "t", "total_candidates": 3, "validated": 2, "failed": 1, "promoted": 1, "from_rules": 3, "from_llm": 0, "avg_benchmark_runs": 2.0}


def entry_of(root, sql, search=12, held=True, selector="candidate-pool"):
    (root / "q.sql").write_text(sql + ";\n")
    sets = lambda phase: json.dumps([ParameterSet(f"{phase}{i}", (("$1", "integer", i),) if "$1" in sql else ()).to_json() for i in range(1, search + 1)])
    (root / "s.json").write_text(sets("s"))
    (root / "h.json").write_text(sets("h"))
    e = workloads.ManifestEntry("q.sql", "s.json", "h.json" if held else None, selector, "case", "a case")
    (root / "m.json").write_text(json.dumps([asdict(e)]))
    return root / "m.json"


def faster(original, better=70.0):
    return lambda sql, values: bench.Measurement((100.0 + len(values.parameter_set_id) if sql == original else better,), 1)


IN = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT ps_partkey FROM partsupp WHERE ps_availqty = $1)"
OUTCOMES = [
    ("parse_rejected", "DROP TABLE orders", {}, {}, "failed"),
    ("baseline_calibration_completed", IN, {}, {"selector": "baseline-only"}, "completed"),
    ("no_candidate", "SELECT o_orderkey FROM orders WHERE o_orderkey = $1", {}, {}, "completed"),
    ("no_validated_candidate", IN, {"most_rows": 0}, {}, "completed"),
    ("candidate_pool", IN, {"search_sets": 3}, {}, "completed"),
    ("promoted", IN, {"held_out": False}, {}, "completed"),
    ("held_out_missing_parameters", IN, {}, {"held": False}, "failed"),
    ("held_out_completed", IN, {}, {}, "completed"),
]


@pytest.mark.parametrize("outcome,sql,options,files_,status", OUTCOMES)
def test_runner_outcomes(spark, context, tmp_path, outcome, sql, options, files_, status):
    manifest = entry_of(tmp_path, sql, **files_)
    store = Store(spark, f"file://{tmp_path}/store")
    o = Options(**({"run_id": "r", "search_sets": 12, "held_out_sets": 12, "validation_sets": 1, "gate": Gate()} | options))
    (result,) = Runner(spark, store, context, o, measure=faster(sql)).run(manifest)
    assert (result.outcome, result.status) == (outcome, status), result
    row = store.table("workload_case_results").first()
    assert row.outcome == outcome and row.workload_label == "case" and (row.failure_stage is None) == (status == "completed")
    if outcome == "held_out_completed":
        assert row.benchmark_pairs == 12 and row.held_out_benchmark_pairs == 12 and store.table("decisions").count() == 1
        pairs = analytics.pair_integrity(store.table("benchmark_runs"))
        assert pairs.filter("integrity_status = 'valid'").count() == 24 and store.pairs().count() == 24
        summary = analytics.template_summary(pairs, samples=50)
        assert summary.filter("reportable_positive_result").count() == 2
        cases, found, invocations = store.table("workload_case_results"), store.table("candidates"), store.table("invocations")
        assert analytics.hypotheses(summary, cases, found).first().h1_hit_rate_pct == 100
        assert analytics.require_single_run(cases, "r") == "r" and analytics.negative_outcomes(cases).count() == 0
        made = analytics.write_reports(str(tmp_path / "reports"), pairs, summary, analytics.source_breakdown(found), analytics.candidate_funnel(cases, invocations, found), analytics.outcome_rollup(cases))
        assert len(made) == 5 and all(p.exists() for p in made.values())
        path, digest = analytics.bundle(str(tmp_path / "reports"), str(tmp_path / "run.zip"))
        assert path.exists() and len(digest) == 64
        assert set(export_run(store, "r", f"file://{tmp_path}/csv")) == {p.name for p in (tmp_path / "csv").iterdir()}
        with pytest.raises(ValueError):
            analytics.require_single_run(cases, "other")


def test_runner_exception_and_preflight(spark, context, tmp_path):
    def broken(sql, values):
        raise RuntimeError("no clock")

    store = Store(spark, f"file://{tmp_path}/store")
    (result,) = Runner(spark, store, context, Options(validation_sets=1), measure=broken).run(entry_of(tmp_path, IN))
    assert (result.outcome, result.failure_stage, result.failure_reason) == ("exception", "search_benchmark", "RuntimeError")


def test_runner_asks_a_proposer(spark, context, tmp_path):
    sql = "SELECT o_orderkey FROM orders WHERE o_orderkey < $1"
    proposer = OfflineProposer({sql: "SELECT o_orderkey FROM orders WHERE $1 > o_orderkey\n---\nSELECT o_orderkey FROM orders WHERE o_orderkey <= $1"})
    store = Store(spark, f"file://{tmp_path}/store")
    o = Options(run_id="r", model="offline:m", validation_sets=2, search_sets=12, held_out=False)
    (result,) = Runner(spark, store, context, o, proposer, faster(sql)).run(entry_of(tmp_path, sql))
    assert result.outcome == "promoted"
    status = {r.sql_text: r.semantic_status for r in store.table("candidates").collect()}
    assert sorted(status.values()) == ["failed", "validated"] and store.table("invocations").first().prompt_hash


def test_previous_row_rewrite(spark):
    Catalog(spark, DATA).register(["lineitem"])
    from gritstone.operators.equivalence import bound
    from gritstone.operators.rules import previous_row_join
    from gritstone.sources.catalog import SchemaContext

    rows = bound(spark, previous_row_join(PREVIOUS_ROW_TEMPLATE.sql, SchemaContext()), ParameterSet("p", (("$1", "integer", 7),))).collect()
    days = defaultdict(set)
    for r in spark.sql("SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_shipdate AS STRING) AS day FROM lineitem WHERE l_partkey <= 7").collect():
        days[r.l_partkey].add(r.day)
    every = set.union(*days.values())
    assert rows and all(r.before_shipdate is None or r.before_shipdate < r.l_shipdate and r.before_shipdate in every for r in rows)
    assert sum(r.before_shipdate is None for r in rows) >= len(days) and any(r.before_shipdate for r in rows)


def test_rates(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:00:00', 'a', 10.0D), (TIMESTAMP '2024-01-01 00:00:05', 'a', 20.0D), (TIMESTAMP '2024-01-01 00:00:10', 'a', 5.0D) AS t(ts, job, value)")
    assert [r.rate for r in analytics.rate_per_second(df, ["job"]).orderBy("ts").collect()] == [None, 2.0, 1.0]


def test_a_promotion_is_one_commit(spark, tmp_path):
    """Candidates, template and decision change together; a writer that comes second loses and changes nothing."""
    store = Store(spark, (tmp_path / "store").as_uri())
    store.insert("query_templates", [{"template_fingerprint": "t"}])
    store.insert("candidates", [{"id": i, "template_fingerprint": "t", "canonical_hash": i, "semantic_status": "validated", "promotion_status": "pool"} for i in "ab"])
    before = store._commit()
    store.promote("t", "a", {"reason": "x"})
    after = store._commit()
    assert after[0] == before[0] + 1 and set(after[1]) == {"query_templates", "candidates", "decisions"}
    late = Store(spark, store.root)
    late._commit = lambda: (before[0], dict(before[1]))
    with pytest.raises(Exception, match="(?i)exist"):
        late.promote("t", "b", {"reason": "y"})
    assert store._commit() == after and [r.candidate_id for r in store.table("decisions").collect()] == ["a"]
