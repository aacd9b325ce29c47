"""Rules: what they rewrite, what they must leave alone, and that rewrites give the same rows."""

import pytest

from gritstone.operators.candidates import generate, rule_candidates, select_intake
from gritstone.operators.equivalence import ParameterSet, validate
from gritstone.operators.proposer import OfflineProposer, PromptBuilder, parse_response
from gritstone.operators.rules import RULES
from gritstone.plans import dialect, sqltext
from gritstone.plans.analyze import canonical_hash, parse_and_analyze, text_fingerprint
from gritstone.sources.catalog import Catalog, SchemaContext, TableInfo
from gritstone.sources.templates import ALL, PREVIOUS_ROW_TEMPLATE

DATA = "/root/testdata/sf0.01"
BY_ID = {r.rule_id: r.apply for r in RULES}


@pytest.fixture(scope="module")
def context(spark):
    return Catalog(spark, DATA).register().schema_context()


APPLIES = [
    ("predicate_redundant_elimination", "SELECT l_orderkey FROM lineitem WHERE l_partkey > 10 AND l_partkey > 250", ["l_partkey > 250"], ["l_partkey > 10"]),
    ("predicate_redundant_elimination", "SELECT l_orderkey FROM lineitem WHERE l_partkey < 10 AND l_partkey < 5.5 AND (l_tax > 0 OR l_discount > 0)", ["< 5.5", "(l_tax > 0 OR l_discount > 0)"], ["< 10"]),
    ("boolean_simplification", "SELECT o_orderkey FROM orders WHERE TRUE AND o_orderkey > 5 AND O_ORDERKEY >  5", ["o_orderkey > 5"], ["TRUE"]),
    ("boolean_simplification", "SELECT o_orderkey FROM orders WHERE FALSE OR o_orderkey = 5 OR o_orderkey = 6", ["o_orderkey = 5 OR o_orderkey = 6"], ["FALSE"]),
    ("comparison_normalization", "SELECT p_partkey FROM part WHERE NOT (p_size <> 3)", ["p_size = 3"], ["NOT"]),
    ("subquery_column_prune", "SELECT q.k FROM (SELECT o_custkey AS k, o_clerk AS c FROM orders) q WHERE q.k > 5", ["o_custkey AS k"], ["o_clerk"]),
    ("in_to_exists", "SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT ps_partkey FROM partsupp WHERE ps_availqty = 1)", ["EXISTS", "partsupp.ps_partkey = lineitem.l_partkey"], [" IN "]),
    ("not_in_to_not_exists", "SELECT c_custkey FROM customer WHERE NOT c_custkey IN (SELECT o_custkey FROM orders)", ["NOT EXISTS"], [" IN "]),
    ("count_gt_zero_to_exists", "SELECT s_suppkey FROM supplier WHERE (SELECT COUNT(*) FROM partsupp WHERE ps_suppkey = s_suppkey) > 0", ["EXISTS"], ["COUNT"]),
    ("implicit_to_explicit_join", "SELECT c_name FROM customer, orders, nation WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey", ["FROM customer\nJOIN nation", "JOIN orders"], ["WHERE"]),
    ("implicit_to_explicit_join_alternate_order", "SELECT c_name FROM customer, orders, nation WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey", ["FROM nation\nJOIN customer", "JOIN orders"], ["WHERE"]),
    ("implicit_to_explicit_join", "SELECT a.n_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey", ["JOIN nation b ON"], ["WHERE"]),
    ("redundant_group_by_elimination", "SELECT k, n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) q GROUP BY k, n", ["GROUP BY o_custkey"], ["GROUP BY k"]),
    ("merge_scalar_aggregates", ALL["rw_10"].sql, ["FILTER (WHERE o_orderpriority = $1::text)", "FROM orders"], ["(SELECT"]),
    ("distinct_join_to_exists", ALL["rw_04"].sql, ["EXISTS"], ["JOIN"]),
    ("or_to_union_all", "SELECT o_orderkey FROM orders WHERE o_custkey > 5 AND (o_orderstatus = 'F' OR o_totalprice > 9)", ["UNION ALL", "(o_orderstatus = 'F') IS NOT TRUE"], [" OR "]),
    ("previous_row_join", PREVIOUS_ROW_TEMPLATE.sql, ["MAX(l_shipdate) OVER", "$1::integer"], ["EXISTS"]),
]


@pytest.mark.parametrize("rule,sql,there,gone", APPLIES)
def test_applies(context, rule, sql, there, gone):
    text = BY_ID[rule](sql, context)
    assert text
    for t in there:
        assert t in text
    for t in gone:
        assert t not in text


@pytest.mark.parametrize("rule,sql", [(r, s) for r, s, _, _ in APPLIES if "$" not in s])
def test_same_rows(spark, context, rule, sql):
    verdict = validate(spark, sql, BY_ID[rule](sql, context), [ParameterSet("p")])
    assert verdict.passed, verdict


DECLINES = [
    ("predicate_redundant_elimination", "SELECT 1 FROM lineitem WHERE l_partkey >= 10 AND l_partkey >= 250"),
    ("predicate_redundant_elimination", "SELECT 1 FROM lineitem WHERE l_partkey > 10 AND l_suppkey > 250"),
    ("predicate_redundant_elimination", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey > 10 AND l_partkey > 250"),
    ("predicate_redundant_elimination", "SELECT l_orderkey FROM lineitem WHERE l_partkey > 10 AND l_partkey > 250 LIMIT 3"),
    ("boolean_simplification", "SELECT 1 FROM orders WHERE o_orderkey = 1 AND o_custkey = 1"),
    ("boolean_simplification", "SELECT 1 FROM orders WHERE rand() > 0.5 AND rand() > 0.5"),
    ("comparison_normalization", "SELECT 1 FROM part WHERE NOT (p_size > 3 AND p_size < 9)"),
    ("comparison_normalization", "SELECT 1 FROM part WHERE NOT (p_size > 3) AND p_size < 9"),
    ("subquery_column_prune", "SELECT * FROM (SELECT o_custkey AS k, o_clerk AS c FROM orders) q"),
    ("subquery_column_prune", "SELECT q.k FROM (SELECT DISTINCT o_custkey AS k, o_clerk AS c FROM orders) q"),
    ("subquery_column_prune", "SELECT q.k FROM (SELECT o_custkey AS k, o_clerk AS c FROM orders) q ORDER BY 1"),
    ("subquery_column_prune", "SELECT k, c FROM (SELECT o_custkey AS k, o_clerk AS c FROM orders) q"),
    ("in_to_exists", "SELECT 1 FROM lineitem WHERE l_partkey IN (SELECT MAX(ps_partkey) FROM partsupp)"),
    ("in_to_exists", "SELECT 1 FROM lineitem WHERE l_partkey IN (1, 2)"),
    ("in_to_exists", "SELECT 1 FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem)"),
    ("in_to_exists", "SELECT 1 FROM lineitem WHERE l_partkey > ANY (SELECT ps_partkey FROM partsupp)"),
    ("not_in_to_not_exists", "SELECT 1 FROM part WHERE p_size NOT IN (SELECT o_custkey FROM orders)"),
    ("count_gt_zero_to_exists", "SELECT 1 FROM supplier WHERE (SELECT COUNT(*) FROM partsupp WHERE ps_availqty > 3) > 0"),
    ("count_gt_zero_to_exists", "SELECT 1 FROM supplier WHERE (SELECT COUNT(*) FROM partsupp WHERE ps_suppkey = s_suppkey) > 1"),
    ("implicit_to_explicit_join", "SELECT 1 FROM customer, orders WHERE c_custkey < o_custkey"),
    ("implicit_to_explicit_join_alternate_order", "SELECT 1 FROM customer, orders WHERE c_custkey = o_custkey"),
    ("redundant_group_by_elimination", "SELECT k FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) q GROUP BY k"),
    ("redundant_group_by_elimination", "SELECT n FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey) q GROUP BY n"),
    ("merge_scalar_aggregates", "SELECT (SELECT SUM(l_tax) FROM lineitem) AS a, (SELECT SUM(o_totalprice) FROM orders) AS b"),
    ("previous_row_join", "SELECT cur.o_orderkey FROM orders cur LEFT JOIN orders prev ON prev.o_custkey = cur.o_custkey AND prev.o_orderdate <= cur.o_orderdate AND NOT EXISTS (SELECT 1 FROM orders mid WHERE mid.o_custkey = cur.o_custkey AND mid.o_orderdate > prev.o_orderdate AND mid.o_orderdate < cur.o_orderdate)"),
]


@pytest.mark.parametrize("rule,sql", DECLINES)
def test_declines(context, rule, sql):
    assert BY_ID[rule](sql, context) is None


def test_not_in_needs_facts_on_both_sides():
    sql = "SELECT a FROM t WHERE a NOT IN (SELECT b FROM u)"
    facts = lambda x, y: SchemaContext({"t": TableInfo("t", {"a": x}), "u": TableInfo("u", {"b": y})})
    rule = BY_ID["not_in_to_not_exists"]
    assert rule(sql, facts(False, False))
    assert not rule(sql, facts(True, False)) and not rule(sql, facts(False, True)) and not rule(sql, SchemaContext())


def test_semantic_traps(spark):
    spark.sql("SELECT * FROM VALUES (1), (1), (2), (NULL) AS t(x)").createOrReplaceTempView("trap")
    p = [ParameterSet("p")]
    assert not validate(spark, "SELECT x FROM trap", "SELECT DISTINCT x FROM trap", p).passed
    assert not validate(spark, "SELECT x FROM trap WHERE x = 1 UNION ALL SELECT x FROM trap WHERE x < 2", "SELECT x FROM trap WHERE x = 1 OR x < 2", p).passed
    assert not validate(spark, "SELECT COALESCE(x, 0) AS x FROM trap", "SELECT x FROM trap", p).passed


def test_analysis(spark):
    of = lambda sql: parse_and_analyze(spark, sql)
    assert of("SELECT a FROM t; SELECT b FROM t").violations == ("multiple_statements",)
    assert of("SELEC a").violations == ("parse_error",) and of(" ").violations == ("parse_error",)
    assert "side_effecting_statement" in of("DROP TABLE t").violations and "not_select" in of("INSERT INTO t SELECT 1").violations
    assert of("SELECT rand() AS r FROM t").violations == ("contains_volatile_function",)
    fine = of("SELECT 'drop rand()' AS x, EXTRACT(YEAR FROM d) AS y FROM t, u WHERE a IN (SELECT b FROM v) AND c LIKE '%x%' AND k = $2 ORDER BY x")
    assert fine.accepted and fine.has_order_by and fine.has_subquery and set(fine.tables) == {"t", "u", "v"} and fine.parameters == (2,)
    assert of("WITH c AS (SELECT 1 AS x FROM t) SELECT COUNT(*) AS n FROM c").has_cte
    assert canonical_hash(spark, "select a from t") == canonical_hash(spark, "SELECT  a\nFROM t") != canonical_hash(spark, "SELECT b FROM t")
    assert text_fingerprint("SELECT 1 \n FROM t") == text_fingerprint("  SELECT 1\nFROM t\n")


def test_dialect():
    assert dialect.to_spark("SELECT $1::numeric, '$2' FROM t WHERE a LIKE '%x' AND b = $10::text;") == "SELECT CAST(:p1 AS DECIMAL(18,6)), '$2' FROM t WHERE a LIKE '%x' AND b = CAST(:p10 AS string)"
    assert dialect.positions("SELECT $2, $1, $2, '$3' -- $4") == [1, 2]
    with pytest.raises(ValueError):
        dialect.bind({}, {1: 2}, [1, 2])
    assert str(dialect.coerce("numeric", 0.0001)) == "0.0001" and dialect.coerce("bigint", "7") == 7


def test_small_numerics_survive_binding(spark):
    from gritstone.operators.equivalence import bound

    row = bound(spark, "SELECT $1::numeric AS a, $2::numeric AS b", ParameterSet("p", (("$1", "numeric", 0.05), ("$2", "numeric", 0.0001)))).first()
    assert float(row.a) == 0.05 and float(row.b) == 0.0001


@pytest.mark.parametrize("name,rules", [("tpch_q05", 2), ("tpch_q11", 2), ("tpch_q12", 1), ("tpch_q16", 1), ("tpch_q20", 1), ("tpch_q02", 0), ("tpch_q03", 0)])
def test_comma_joins(spark, context, name, rules):
    """Lists of tables become joins, from either end if there are three; an outer LIMIT keeps every rule away."""
    t = ALL[name]
    text = dialect.inline(t.sql, t.types, t.values)
    ids = {c.applied_rules[0] for c in rule_candidates(spark, text, context)[0]}
    assert len({x for x in ids if x.startswith("implicit_to_explicit_join")}) == rules
    if "LIMIT" in text:
        assert BY_ID["implicit_to_explicit_join"](text.rpartition("LIMIT")[0], context)


def test_joins_without_a_tie_stay(context):
    assert BY_ID["distinct_join_to_exists"]("SELECT DISTINCT s.s_name FROM supplier s JOIN nation n ON s.s_nationkey = s.s_suppkey", context) is None


def test_pool(spark, context):
    sql = "SELECT c_name FROM customer, orders, nation WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey"
    made, _, _ = rule_candidates(spark, sql, context)
    assert [c.applied_rules[0] for c in made] == ["implicit_to_explicit_join", "implicit_to_explicit_join_alternate_order"]
    assert all(c.rule_certified and c.structurally_valid for c in made)
    assert len(rule_candidates(spark, sql, context, most=1)[0]) == 1 and not rule_candidates(spark, sql, context, families=["A"])[0]
    answer = f"Here:\n```sql\n{made[0].sql}\n```\n---\nDROP TABLE orders\n---\nSELECT c_name AS other FROM customer\n---\nSELECT a b c d FROM t\n---\n{sql}\n---\nno idea\n---\nSELECT 1; SELECT 2"
    pool = generate(spark, sql, context, proposer=OfflineProposer({sql: answer}), model="offline:x")
    reasons = {r.reason for r in pool.rejected}
    assert {"duplicate_candidate", "unsafe_non_select_output", "structural_validation_failed", "parse_or_structural_validation_failed", "candidate_same_as_original", "non_sql_output", "multiple_statements"} <= reasons
    assert len(select_intake(pool.candidates, "candidate-pool")) == 2 and not select_intake(pool.candidates, "first-llm-candidate")
    assert len(select_intake(pool.candidates, "first-rule-candidate")) == 2 and len(select_intake(pool.candidates, "rule:implicit_to_explicit_join")) == 1
    assert generate(spark, sql, context, sources=["llm"]).rejected[0].reason == "model_not_configured"
    assert generate(spark, sql, context, sources=["llm"], proposer=OfflineProposer(), model="other:x").rejected[0].reason == "unsupported_model_provider:other"


def test_prompt_and_response(context):
    a, b = PromptBuilder().build("SELECT 1", context), PromptBuilder().build("SELECT 2", context)
    assert a.hash != b.hash and a.hash == PromptBuilder().build("SELECT 1", context).hash
    assert parse_response("NO_OPTIMIZATION") == ([], [])
    assert parse_response("WITH a AS (SELECT 1) SELECT * FROM a;")[0] == ["WITH a AS (SELECT 1) SELECT * FROM a"]


def test_reader():
    read = sqltext.read("SELECT a, CASE WHEN b AND c THEN 1 ELSE 2 END AS d FROM t WHERE x BETWEEN 1 AND 2 AND (y OR z) GROUP  BY a ORDER BY a")
    assert [i.label for i in read.items] == ["a", "d"] and sqltext.conjuncts(read.where) == ["x BETWEEN 1 AND 2", "(y OR z)"] and read.group == "a"
    assert sqltext.read("SELECT 1 UNION SELECT 2") is None and sqltext.read("WITH a AS (SELECT 1) SELECT 1") is None


def test_rewrites_that_change_the_plan(spark, context):
    """Catalyst keeps these patterns as written: the rewrite is what makes a plain anti join, a semi join, one scan."""
    plan = lambda sql: spark.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
    sql = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
    assert "isnull" in plan(sql).split("LeftAnti")[1].splitlines()[0] and "isnull" not in plan(BY_ID["not_in_to_not_exists"](sql, context)).split("LeftAnti")[1].splitlines()[0]
    sql = "SELECT s_suppkey FROM supplier WHERE (SELECT COUNT(*) FROM partsupp WHERE ps_suppkey = s_suppkey) > 0"
    assert "LeftSemi" not in plan(sql) and "LeftSemi" in plan(BY_ID["count_gt_zero_to_exists"](sql, context))
    sql = dialect.inline(ALL["rw_10"].sql, ALL["rw_10"].types, ALL["rw_10"].values)
    assert plan(BY_ID["merge_scalar_aggregates"](sql, context)).count("Relation [") == 1
