"""Registered queries for decisions, statistics, records and analysis, with oracles that compute the same in SQL.

Their inputs are derived from the relational tables by portable SQL, like those of ``queries_engine``.
"""

from __future__ import annotations

import datetime as dt
import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import analytics, bandit, promotion
from gritstone.operators.bench import Measurement, Pair, run_pairs
from gritstone.operators.candidates import rule_candidates
from gritstone.operators.equivalence import ParameterSet, validate, with_rank
from gritstone.operators.rules import explicit_joins, explicit_joins_from_last
from gritstone.plans import dialect
from gritstone.plans.analyze import parse_and_analyze
from gritstone.queries_engine import CANDIDATES, REWRITTEN, made
from gritstone.session import shared_dir, ship_package
from gritstone.sources import files, movies, workloads
from gritstone.sources.catalog import VIEWS, Catalog, SchemaContext
from gritstone.sources.store import Store, new_id
from gritstone.sources.templates import ALL, ANTI_PATTERNS, TPCH

# --- decisions --------------------------------------------------------------------------------------------------

#: Measured pairs, about a dozen for each group; many differences tie, some are zero, some groups lose.
MEASURED = """SELECT CAST(FLOOR(c_custkey / 12.0) AS BIGINT) AS grp, c_custkey AS pair_no, CAST(60 + (c_custkey * 37) % 41 AS DOUBLE) AS baseline_ms,
  CAST(60 + (c_custkey * 37) % 41 - ((c_custkey * 53) % 7 - 2) * (CAST(FLOOR(c_custkey / 12.0) AS BIGINT) % 5) - CASE WHEN CAST(FLOOR(c_custkey / 12.0) AS BIGINT) % 9 = 4 THEN 30 ELSE 0 END AS DOUBLE) AS candidate_ms
  FROM customer"""
GATES = "grp bigint, promoted boolean, reason string, pairs int, baseline_median_ms double, candidate_median_ms double, improvement_pct double, p_value double, cv double"


def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Every group's pairs through the gates of promotion."""
    ship_package(spark)

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        point = lambda ms: Measurement((ms,), 1)
        pairs = [Pair(str(r.pair_no), "held_out", "s", "baseline_first", point(r.baseline_ms), point(r.candidate_ms)) for r in rows.sort_values("pair_no").itertuples()]
        e = promotion.evaluate(pairs)
        return pd.DataFrame([[key[0], e.promoted, e.reason, e.pairs, e.baseline_median_ms, e.candidate_median_ms, round(e.improvement_pct, 6), round(e.p_value, 9), round(e.cv, 6)]], columns=[c.split()[0] for c in GATES.split(", ")])

    return made(spark, sf, MEASURED).groupBy("grp").applyInPandas(judge, GATES)


GATES_ORACLE = f"""
WITH RECURSIVE m AS ({MEASURED}),
basic AS (
  SELECT grp, count(*) AS n, quantile_cont(baseline_ms, 0.5) AS b, quantile_cont(candidate_ms, 0.5) AS c,
    avg(greatest(0.0, (baseline_ms - candidate_ms) / baseline_ms)) AS mean_reward, stddev_samp(greatest(0.0, (baseline_ms - candidate_ms) / baseline_ms)) AS sd FROM m GROUP BY grp),
signs AS (SELECT grp, pair_no, abs(baseline_ms - candidate_ms) AS size, sign(baseline_ms - candidate_ms) AS sg FROM m WHERE baseline_ms <> candidate_ms),
ranked AS (SELECT *, CAST(2 * rank() OVER (PARTITION BY grp ORDER BY size) + count(*) OVER (PARTITION BY grp, size) - 1 AS BIGINT) AS twice, row_number() OVER (PARTITION BY grp ORDER BY size, pair_no) AS i FROM signs),
seen AS (SELECT grp, count(*) AS k, sum(CASE WHEN sg > 0 THEN twice ELSE 0 END) AS observed FROM ranked GROUP BY grp),
ways(grp, i, total, n) AS (
  SELECT grp, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM seen
  UNION ALL
  SELECT grp, i, total, sum(n) FROM (
    SELECT w.grp, w.i + 1 AS i, w.total + t.up * r.twice AS total, w.n / 2 AS n
    FROM ways w JOIN ranked r ON r.grp = w.grp AND r.i = w.i + 1 CROSS JOIN (VALUES (0), (1)) AS t(up)) GROUP BY grp, i, total),
tested AS (SELECT w.grp, sum(CASE WHEN w.total >= s.observed THEN w.n ELSE 0 END) AS p FROM ways w JOIN seen s ON s.grp = w.grp AND s.k = w.i GROUP BY w.grp),
told AS (
  SELECT basic.grp, n, b, c, (b - c) / b * 100 AS gain, coalesce(p, 1) AS p, CASE WHEN n < 2 OR abs(mean_reward) < 1e-12 THEN 0 ELSE sd / abs(mean_reward) END AS cv
  FROM basic LEFT JOIN tested ON tested.grp = basic.grp),
judged AS (
  SELECT *, CASE WHEN n < 10 THEN 'statistically_insufficient' WHEN gain < 2 THEN 'improvement_below_threshold' WHEN cv > 0.3 THEN 'candidate_relative_latency_unstable'
    WHEN p >= 0.05 THEN 'not_statistically_significant' ELSE 'paired_statistical_evidence' END AS reason FROM told)
SELECT grp, reason = 'paired_statistical_evidence' AS promoted, reason, CAST(n AS INTEGER) AS pairs, b AS baseline_median_ms, c AS candidate_median_ms,
  round(gain, 6) AS improvement_pct, round(p, 9) AS p_value, round(cv, 6) AS cv FROM judged"""

#: Batches of rewards: each order is one, for an arm of its customer.
BATCHES = """SELECT o_custkey AS arm, o_custkey % 50 AS template, o_orderkey AS batch, CAST(o_orderkey % 7 AS DOUBLE) / 10 AS r1, CAST(o_custkey % 5 AS DOUBLE) / 10 AS r2 FROM orders"""
ARMS = "arm bigint, template bigint, pulls bigint, mean_reward double, posterior_mean double, posterior_variance double, ucb_score double"


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    """Every arm after its batches, each an update of the posterior; the score counts all pulls of its template."""
    ship_package(spark)
    batches = made(spark, sf, BATCHES)
    pulls = batches.groupBy("template").agg((2 * F.count(F.lit(1))).alias("all_pulls"))

    def play(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        arm, rows = bandit.Arm(str(key[0])), rows.sort_values("batch")
        others = int(rows["all_pulls"].iloc[0]) - 2 * len(rows)
        for r in rows.itertuples():
            arm = bandit.update(arm, [r.r1, r.r2], int(r.batch), others_pulls=others)
        return pd.DataFrame([[key[0], rows["template"].iloc[0], arm.pulls, arm.mean_reward, arm.posterior_mean, arm.posterior_variance, arm.ucb_score]], columns=[c.split()[0] for c in ARMS.split(", ")])

    return batches.join(pulls, "template").groupBy("arm").applyInPandas(play, ARMS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean_reward", "posterior_mean", "posterior_variance", "ucb_score")})


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """The arm that UCB1 pulls next in each template."""

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        arms = [bandit.Arm(f"{r.arm:012}", pulls=int(r.pulls), mean_reward=r.mean_reward) for r in rows.itertuples()]
        return pd.DataFrame([[key[0], int(bandit.choose(arms, bandit.UCB).candidate_id)]], columns=["template", "arm"])

    return _arms(spark, sf).groupBy("template").applyInPandas(pick, "template bigint, arm bigint")


_ARMS_SQL = f"""b AS ({BATCHES}),
whole AS (SELECT template, 2 * count(*) AS all_pulls FROM b GROUP BY template),
arms AS (
  SELECT arm, template, 2 * count(*) AS pulls, sum(r1 + r2) / (2 * count(*)) AS mean_reward, (0.5 + sum((r1 + r2) / 2) / 0.1) / (1 + count(*) / 0.1) AS posterior_mean,
    1 / (1 + count(*) / 0.1) AS posterior_variance FROM b GROUP BY arm, template),
scored AS (SELECT arms.*, mean_reward + sqrt(2.0) * sqrt(ln(all_pulls) / pulls) AS ucb_score FROM arms JOIN whole ON whole.template = arms.template)"""


# --- validation -------------------------------------------------------------------------------------------------

ORDERED = "SELECT CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, o_orderkey FROM orders ORDER BY o_orderdate, o_orderpriority"


def ordered_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an ordered query with the number of their run of equal sort keys."""
    Catalog(spark, sf).base("orders").createOrReplaceTempView("orders")
    ranked = with_rank(spark.sql(ORDERED).toDF("_0", "_1", "_2"), [0, 1])
    return ranked.select(F.col("_2").alias("o_orderkey"), F.col("_run").cast("long").alias("run"))


#: Pairs of texts, and whether the candidate's rows must come in the original's order.
CHECKED = {
    "same_rows": ("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3", "SELECT n_name, n_regionkey FROM nation WHERE NOT n_regionkey >= 3"),
    "fewer_rows": ("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'"),
    "other_rows": ("SELECT s_name FROM supplier WHERE s_suppkey < 9", "SELECT s_name FROM supplier WHERE s_suppkey < 10 AND s_suppkey > 1"),
    "union_doubles": ("SELECT p_partkey FROM part WHERE p_size < 9 OR p_partkey < 40", "SELECT p_partkey FROM part WHERE p_size < 9 UNION ALL SELECT p_partkey FROM part WHERE p_partkey < 40"),
    "disjoint_union": ("SELECT p_partkey FROM part WHERE p_size < 9 OR p_partkey < 40", "SELECT p_partkey FROM part WHERE p_size < 9 UNION ALL SELECT p_partkey FROM part WHERE p_partkey < 40 AND (p_size < 9) IS NOT TRUE"),
}


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of full comparison."""
    Catalog(spark, sf).register(["nation", "orders", "supplier", "part"])
    rows = []
    for name, (a, b) in CHECKED.items():
        v = validate(spark, a, b, [ParameterSet("p")], most_rows=None)
        rows.append((name, v.passed, v.checks[0].original_rows, v.checks[0].candidate_rows, v.reason))
    return spark.createDataFrame(rows, "pair string, passed boolean, original_rows bigint, candidate_rows bigint, reason string")


def _verdict_sql(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS pair, d = 0 AS passed, (SELECT count(*) FROM ({a})) AS original_rows, (SELECT count(*) FROM ({b})) AS candidate_rows,
  CASE WHEN d = 0 THEN '' ELSE 'row_multiset_mismatch' END AS reason
  FROM (SELECT (SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))) + (SELECT count(*) FROM (({b}) EXCEPT ALL ({a}))) AS d)"""


# --- records ----------------------------------------------------------------------------------------------------


def records(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the store after inserts, an upsert, an insert of what is missing, and an update."""
    store = Store(spark, f"{shared_dir(spark)}/gritstone/store-{new_id()}")
    rows = [{"candidate_id": f"s{r.s_suppkey}", "template_fingerprint": f"t{r.s_nationkey}", "strategy": "ucb1", "total_pulls": int(r.s_suppkey % 7), "mean_reward": float(r.s_nationkey)} for r in Catalog(spark, sf).base("supplier").filter("s_suppkey <= 200").collect()]
    number = lambda r: int(r["candidate_id"][1:])
    store.insert("bandit_state", [r for r in rows if number(r) % 2 == 0])
    store.upsert("bandit_state", [r | {"total_pulls": 100} for r in rows if number(r) % 3 == 0])
    store.insert_missing("bandit_state", [r | {"strategy": "thompson"} for r in rows])
    store.update("bandit_state", F.col("total_pulls") > 50, mean_reward=0.25)
    return store.table("bandit_state").select("candidate_id", "template_fingerprint", "strategy", F.col("total_pulls").cast("long").alias("total_pulls"), "mean_reward")


RECORDS_ORACLE = """SELECT 's' || CAST(s_suppkey AS STRING) AS candidate_id, 't' || CAST(s_nationkey AS STRING) AS template_fingerprint,
  CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'ucb1' ELSE 'thompson' END AS strategy,
  CAST(CASE WHEN s_suppkey % 3 = 0 THEN 100 ELSE s_suppkey % 7 END AS BIGINT) AS total_pulls,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.25 ELSE CAST(s_nationkey AS DOUBLE) END AS mean_reward FROM supplier WHERE s_suppkey <= 200"""


def promoted(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates, template and decision after a promotion that takes the place of an earlier one, and after one that is refused."""
    store = Store(spark, f"{shared_dir(spark)}/gritstone/store-{new_id()}")
    found = made(spark, sf, CANDIDATES).filter("template_fingerprint = 't1' AND promotion_status <> 'evicted'").select("id", "template_fingerprint", "semantic_status").orderBy("id").limit(400).collect()
    store.insert("query_templates", [{"template_fingerprint": "t1"}])
    store.insert("candidates", [r.asDict() | {"canonical_hash": r.id, "promotion_status": "pool"} for r in found])
    valid = [r.id for r in found if r.semantic_status == "validated"]
    for chosen in (valid[0], valid[-1], next(r.id for r in found if r.semantic_status != "validated")):
        try:
            store.promote("t1", chosen, {"reason": "paired_statistical_evidence"})
        except ValueError:
            pass  # only validated ones may be
    current = store.table("query_templates").select(F.col("template_fingerprint"), "current_candidate_id")
    decided = store.table("decisions").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("decisions"))
    out = store.table("candidates").join(current, "template_fingerprint").join(decided, F.col("candidate_id") == F.col("id"), "left")
    return out.select("id", "promotion_status", (F.col("id") == F.col("current_candidate_id")).alias("is_current"), F.coalesce("decisions", F.lit(0)).cast("long").alias("decisions"))


PROMOTED_ORACLE = f"""WITH found AS (SELECT id, semantic_status FROM ({CANDIDATES}) WHERE template_fingerprint = 't1' AND promotion_status <> 'evicted' ORDER BY id LIMIT 400),
ends AS (SELECT min(id) AS low, max(id) AS high FROM found WHERE semantic_status = 'validated')
SELECT id, CASE WHEN id = high THEN 'promoted' ELSE 'pool' END AS promotion_status, id = high AS is_current, CAST(CAST(id IN (low, high) AS INT) AS BIGINT) AS decisions FROM found, ends"""


def store_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Arms of a template: its validated candidates that were not evicted, with their state, oldest first."""
    store = Store(spark, f"{shared_dir(spark)}/gritstone/store-{new_id()}")
    begin = dt.datetime(2024, 1, 1)
    found = made(spark, sf, CANDIDATES).filter("template_fingerprint IN ('t1', 't2')").select("id", "template_fingerprint", "semantic_status", "promotion_status", "benchmark_runs").orderBy("id").limit(500).collect()
    store.insert("candidates", [r.asDict() | {"canonical_hash": r.id, "created_at": begin + dt.timedelta(hours=int(r.id[1:]) % 11)} for r in found])
    store.insert("bandit_state", [{"candidate_id": r.id, "template_fingerprint": r.template_fingerprint, "total_pulls": r.benchmark_runs} for r in found if r.benchmark_runs % 3])
    arms = store.arms("t1").select("id", "total_pulls").collect()
    return spark.createDataFrame([(i, r.id, int(r.total_pulls)) for i, r in enumerate(arms, 1)], "place bigint, id string, total_pulls bigint")


ARMS_ORACLE = f"""WITH found AS (SELECT * FROM ({CANDIDATES}) WHERE template_fingerprint IN ('t1', 't2') ORDER BY id LIMIT 500)
SELECT row_number() OVER (ORDER BY CAST(substr(id, 2) AS BIGINT) % 11, id) AS place, id, CAST(benchmark_runs AS BIGINT) AS total_pulls
FROM found WHERE template_fingerprint = 't1' AND semantic_status = 'validated' AND promotion_status <> 'evicted' AND benchmark_runs % 3 <> 0"""


# --- analysis ---------------------------------------------------------------------------------------------------

SUMMARIES = """SELECT 'c' || CAST(p_partkey AS STRING) AS candidate_id, CASE WHEN p_partkey % 2 = 0 THEN 'held_out' ELSE 'search' END AS benchmark_phase, p_size % 3 = 0 AS reportable_positive_result FROM part"""
ATTEMPTED = """SELECT c_mktsegment || CAST(c_custkey % 40 AS STRING) AS workload_label, c_custkey % 4 <> 0 AS equivalence_passed, c_nationkey % 6 AS benchmark_pairs FROM customer"""


def _hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.hypotheses(made(spark, sf, SUMMARIES), made(spark, sf, ATTEMPTED), made(spark, sf, CANDIDATES)).withColumn("h1_hit_rate_pct", F.round("h1_hit_rate_pct", 6))


HYPOTHESES_ORACLE = f"""SELECT *, round(h1_positive / attempted * 100.0, 6) AS h1_hit_rate_pct FROM
  (SELECT count(*) FILTER (WHERE reportable_positive_result) AS h1_positive, count(*) AS held_out_summaries FROM ({SUMMARIES}) s
   WHERE benchmark_phase = 'held_out' AND candidate_id IN (SELECT id FROM ({CANDIDATES}) WHERE promotion_status = 'promoted')),
  (SELECT count(DISTINCT workload_label) AS attempted, count(*) FILTER (WHERE equivalence_passed) AS validated_cases, count(*) FILTER (WHERE benchmark_pairs > 0) AS measured_cases FROM ({ATTEMPTED}))"""


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of events, as rates by second; one sample for each second and kind."""
    samples = Catalog(spark, sf).base("events").groupBy("event_type", F.date_trunc("second", "ts").alias("ts")).agg(F.max("value").alias("value"))
    return analytics.rate_per_second(samples, ["event_type"]).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "rate")


RATES_ORACLE = """WITH samples AS (SELECT event_type, date_trunc('second', ts) AS ts, max(value) AS value FROM events GROUP BY ALL),
lagged AS (SELECT *, lag(value) OVER w AS before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM samples WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, epoch_us(ts) AS at, CASE WHEN us > 0 THEN CASE WHEN value >= before THEN value - before ELSE value END / (us / 1e6) END AS rate FROM lagged"""


def windows(spark: SparkSession, sf: str) -> DataFrame:
    found = analytics.window_totals(Catalog(spark, sf).base("events"), "event_type", "6 hours")
    return found.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"), "event_type", "samples", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"))


WINDOWS_ORACLE = """WITH each AS (SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS window_start, event_type, count(*) AS samples, sum(value) AS total FROM events GROUP BY ALL)
SELECT window_start, event_type, samples, round(total, 4) AS total, round(CASE WHEN sum(total) OVER (PARTITION BY window_start) <> 0 THEN total / sum(total) OVER (PARTITION BY window_start) END, 6) AS share FROM each"""


# --- texts and workloads ----------------------------------------------------------------------------------------

_TEXTS = [*TPCH, *ANTI_PATTERNS]
_texts_sql = "(VALUES " + ", ".join("('{}', '{}')".format(t.name, t.sql.replace("'", "''")) for t in _TEXTS) + ") AS t(name, text)"


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """What the analysis of every template's text says."""
    rows = []
    for t in _TEXTS:
        a = parse_and_analyze(spark, t.sql)
        rows.append((t.name, a.accepted, len(a.parameters), a.has_order_by, a.has_cte, ",".join(sorted(x for x in a.tables if x in VIEWS))))
    return spark.createDataFrame(rows, "name string, accepted boolean, parameters bigint, has_order_by boolean, has_cte boolean, tables string")


ANALYSES_ORACLE = rf"""SELECT name, true AS accepted, CAST(len(list_distinct(regexp_extract_all(text, '\$(\d+)', 1))) AS BIGINT) AS parameters,
  text LIKE '%ORDER BY%' AND regexp_matches(text, '(?s)ORDER BY [^)]*$') AS has_order_by, starts_with(text, 'WITH ') AS has_cte,
  array_to_string(list_sort(list_filter(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'partsupp'],
    lambda x: regexp_matches(lower(text), '(from|join|,)\s+' || x || '(\s|,|$)'))), ',') AS tables
FROM {_texts_sql}"""


def rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """For each rule's query: whether that rule makes a candidate of it, well formed, certified, and different."""
    context = Catalog(spark, sf).register().schema_context()
    rows = []
    for rule, text in REWRITTEN.items():
        mine = [c for c in rule_candidates(spark, text, context, most=99)[0] if c.applied_rules == (rule,)]
        rows.append((rule, len(mine), all(c.structurally_valid and c.rule_certified for c in mine), all(c.sql != text for c in mine)))
    return spark.createDataFrame(rows, "rule string, candidates bigint, certified boolean, changed boolean")


def sets(spark: SparkSession, sf: str) -> DataFrame:
    """Parameter sets of every template: how many, with how many places, and that search and held-out values differ."""
    rows = []
    for t in _TEXTS:
        rng, taken = random.Random(7), set()
        search = workloads.parameter_sets(t, "search", 20, rng, taken=taken)
        held = workloads.parameter_sets(t, "held-out", 10, rng, taken=taken)
        again = workloads.parameter_sets(t, "search", 20, random.Random(7), taken=set())
        rows.append((t.name, len(search), len(held), len(search[0].parameters), search == again, {s.parameter_set_id for s in search}.isdisjoint({s.parameter_set_id for s in held})))
    return spark.createDataFrame(rows, "name string, search bigint, held_out bigint, places bigint, repeatable boolean, disjoint boolean")


def orders_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """In which order 25 pairs ran: alternating, after one warm-up of each side."""
    ran: list[str] = []

    def fake(sql: str, values: ParameterSet) -> Measurement:
        ran.append(sql)
        return Measurement((float(len(ran)),), 1)

    pairs = run_pairs(fake, "b", "c", [ParameterSet(f"p{i}") for i in range(25)], "search")
    return spark.createDataFrame([(i, p.parameter_set_id, p.order, p.baseline.median_ms, p.candidate.median_ms) for i, p in enumerate(pairs)], "pair bigint, parameter_set_id string, ran string, baseline_at double, candidate_at double")


def schema_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, keys, references and row counts of the relational tables but the lines', whose declared key the data break."""
    return Catalog(spark, sf).facts([t for t in VIEWS if t != "lineitem"])


#: column, not null, in the key, refers to.
_COLUMNS = {
    "region": ("r_regionkey !*", "r_name"),
    "nation": ("n_nationkey !*", "n_name", "n_regionkey ! region.r_regionkey"),
    "supplier": ("s_suppkey !*", "s_name", "s_address", "s_nationkey ! nation.n_nationkey", "s_phone", "s_acctbal", "s_comment"),
    "customer": ("c_custkey !*", "c_name", "c_address", "c_nationkey ! nation.n_nationkey", "c_phone", "c_acctbal", "c_mktsegment", "c_comment"),
    "part": ("p_partkey !*", "p_name", "p_mfgr", "p_brand", "p_type", "p_size", "p_container", "p_retailprice"),
    "orders": ("o_orderkey !*", "o_custkey ! customer.c_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_clerk", "o_shippriority", "o_comment"),
    "partsupp": ("ps_partkey !* part.p_partkey", "ps_suppkey !* supplier.s_suppkey", "ps_availqty", "ps_supplycost"),
}


def _facts_sql() -> str:
    rows = []
    for table, columns in _COLUMNS.items():
        source = f"({VIEWS[table]})" if table == "partsupp" else table
        for i, c in enumerate(columns, 1):
            name, marks, target = (c.split(" ") + ["", ""])[:3]
            told = f"'{target}'" if target else "NULL"
            rows.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, CAST({i} AS BIGINT) AS place, {'false' if '!' in marks else 'true'} AS nullable, {'true' if '*' in marks else 'false'} AS in_key, CAST({told} AS VARCHAR) AS refers_to, (SELECT count(*) FROM {source}) AS row_estimate")
    return "\nUNION ALL ".join(rows)


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table through the CSV sink and scan, with quotes, separators and line ends in its text."""
    path = f"{shared_dir(spark)}/gritstone/csv-{new_id()}"
    odd = Catalog(spark, sf).base("part").select("p_partkey", F.concat("p_name", F.lit(', "x"\ny')).alias("p_name"), "p_retailprice")
    files.write_csv(odd, path)
    return spark.read.schema(odd.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _join(name: str, rule: Callable | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A join-order question as it is, or after a rule."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        text = rule(movies.JOINS[name], SchemaContext()) if rule else movies.JOINS[name]
        if text is None:
            raise ValueError(f"no joins found in {name}")
        movies.register(spark, sf, movies.used(movies.JOINS[name]))
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "promotion_gates": gates,
    "bandit_update": lambda spark, sf: _rounded(_arms(spark, sf)),
    "bandit_choice": choices,
    "equivalence_ordered_runs": ordered_runs,
    "equivalence_verdicts": verdicts,
    "store_records": records,
    "store_promotion": promoted,
    "store_arms": store_arms,
    "hypotheses": _hypotheses,
    "monitoring_rates": rates,
    "monitoring_windows": windows,
    "text_analysis": analyses,
    "rule_candidates": rewrites,
    "parameter_sets": sets,
    "pair_orders": orders_of_pairs,
    "schema_facts": schema_facts,
    "csv_round_trip": csv_round_trip,
    **{name: _join(name) for name in movies.JOINS},
    **{f"{name}_explicit": _join(name, explicit_joins if i % 2 else explicit_joins_from_last) for i, name in enumerate(movies.JOINS)},
}
ORACLES: dict[str, str] = {
    "promotion_gates": GATES_ORACLE,
    "bandit_update": f"WITH {_ARMS_SQL} SELECT arm, template, pulls, round(mean_reward, 6) AS mean_reward, round(posterior_mean, 6) AS posterior_mean, round(posterior_variance, 6) AS posterior_variance, round(ucb_score, 6) AS ucb_score FROM scored",
    "bandit_choice": f"WITH {_ARMS_SQL} SELECT template, min(arm) AS arm FROM (SELECT *, max(ucb_score) OVER (PARTITION BY template) AS best FROM scored) WHERE ucb_score >= best - 1e-12 GROUP BY template",
    "equivalence_ordered_runs": "SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderpriority) - 1 AS run FROM orders",
    "equivalence_verdicts": "\nUNION ALL ".join(_verdict_sql(name, a, b) for name, (a, b) in CHECKED.items()),
    "store_records": RECORDS_ORACLE,
    "store_promotion": PROMOTED_ORACLE,
    "store_arms": ARMS_ORACLE,
    "hypotheses": HYPOTHESES_ORACLE,
    "monitoring_rates": RATES_ORACLE,
    "monitoring_windows": WINDOWS_ORACLE,
    "text_analysis": ANALYSES_ORACLE,
    "rule_candidates": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', CAST(1 AS BIGINT), true, true)" for r in REWRITTEN) + ") AS t(rule, candidates, certified, changed)",
    "parameter_sets": f"SELECT name, CAST(20 AS BIGINT) AS search, CAST(10 AS BIGINT) AS held_out, CAST(len(list_distinct(regexp_extract_all(text, '\\$(\\d+)', 1))) AS BIGINT) AS places, true AS repeatable, true AS disjoint FROM {_texts_sql}",
    "pair_orders": """SELECT i AS pair, 'p' || CAST(i AS STRING) AS parameter_set_id, CASE WHEN i % 2 = 0 THEN 'baseline_first' ELSE 'candidate_first' END AS ran,
  CAST(2 * i + CASE WHEN i % 2 = 0 THEN 3 ELSE 4 END AS DOUBLE) AS baseline_at, CAST(2 * i + CASE WHEN i % 2 = 0 THEN 4 ELSE 3 END AS DOUBLE) AS candidate_at FROM range(25) AS t(i)""",
    "schema_facts": _facts_sql(),
    **{name: movies.oracle(sql) for name, sql in movies.JOINS.items()},
    **{f"{name}_explicit": movies.oracle(sql) for name, sql in movies.JOINS.items()},
    "csv_round_trip": "SELECT p_partkey, p_name || ', \"x\"' || chr(10) || 'y' AS p_name, p_retailprice FROM part",
}
