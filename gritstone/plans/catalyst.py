"""The one module that reaches into Catalyst: parsed plans, optimized plans and executed plans.

It goes through the session's JVM object, which is no public interface; nothing else in the library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


class ParseFailed(ValueError):
    """The text is not SQL that Spark can parse."""


def parse(spark: SparkSession, sql: str):
    """The unresolved plan of one statement."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ParseFailed(str(getattr(e, "java_exception", e)).split("\n")[0][:300]) from None


def name_of(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _seq(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def walk(plan) -> Iterator[tuple[str, object]]:
    """(kind, node) of every plan and expression node, subquery plans included."""
    yield "plan", plan
    for e in _seq(plan.expressions()):
        yield from _expressions(e)
    if name_of(plan) == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            yield from walk(pair._2())
    for child in _seq(plan.children()):
        yield from walk(child)


def _expressions(e) -> Iterator[tuple[str, object]]:
    yield "expression", e
    kind = name_of(e)
    if kind in ("ScalarSubquery", "Exists", "ListQuery"):
        yield from walk(e.plan())
    elif kind == "InSubquery":
        yield from _expressions(e.query())
    for child in _seq(e.children()):
        yield from _expressions(child)


def cte_names(plan) -> set[str]:
    return {str(pair._1()).lower() for kind, node in walk(plan) if kind == "plan" and name_of(node) == "UnresolvedWith" for pair in _seq(node.cteRelations())}


def relations(plan) -> list[str]:
    """Names of the tables that the statement reads, in order of appearance, without its common table expressions."""
    found = [list(_seq(node.multipartIdentifier()))[-1].lower() for kind, node in walk(plan) if kind == "plan" and name_of(node) == "UnresolvedRelation"]
    local = cte_names(plan)
    return [t for t in dict.fromkeys(found) if t not in local]


def functions(plan) -> set[str]:
    return {list(_seq(node.nameParts()))[-1].lower() for kind, node in walk(plan) if kind == "expression" and name_of(node) == "UnresolvedFunction"}


def canonical(plan) -> str:
    """The plan as text without the numbers that differ between parses."""
    return re.sub(r"#\d+L?|\bplan_id=\d+", "", plan.treeString())


def fingerprint(spark: SparkSession, sql: str) -> str:
    """Equal for texts that parse alike."""
    return sha256(canonical(parse(spark, sql)).encode()).hexdigest()


def optimized_fingerprint(df: DataFrame) -> str:
    """Equal for queries that Catalyst optimizes to the same plan, whatever their expression ids."""
    text = df._jdf.queryExecution().optimizedPlan().canonicalized().treeString()
    return sha256(re.sub(r"#\d+L?", "#", text).encode()).hexdigest()


def plan_nodes(df: DataFrame) -> list[dict]:
    """Nodes of the physical plan: after an action, of the adaptive plan that ran, each with its metrics."""
    out: list[dict] = []

    def visit(node, depth: int) -> None:
        name = name_of(node)
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan(), depth)
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"):
            return visit(node.plan(), depth)
        metrics = {}
        it = node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            metrics[pair._1()] = int(pair._2().value())
        if name not in ("WholeStageCodegenExec", "InputAdapter"):
            out.append({"node": name, "depth": depth, "metrics": metrics})
        for child in _seq(node.children()):
            visit(child, depth + 1)
        for sub in _seq(node.subqueries()):
            visit(sub, depth + 1)

    visit(df._jdf.queryExecution().executedPlan(), 0)
    return out


def run(df: DataFrame) -> int:
    """Run this frame's own physical plan in the JVM, so that its nodes get their metrics; rows are counted, not moved."""
    return int(df._jdf.queryExecution().toRdd().count())


def plan_json(df: DataFrame) -> str:
    return json.dumps(plan_nodes(df))
