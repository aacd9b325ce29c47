"""Whether two queries give the same results: evidence by comparison over parameter sets, not a proof.

Rows are compared on the executors: as multisets by counts per distinct row, and with an ordering by rank of the sort
keys and then as multisets within ties, so that rows that tie may come in either order.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from gritstone.plans import dialect, sqltext


@dataclass(frozen=True)
class ParameterSet:
    """Named values for a template: (position, type, value) triples."""

    parameter_set_id: str
    parameters: tuple[tuple[str, str, Any], ...] = ()

    @staticmethod
    def from_json(x: dict) -> ParameterSet:
        return ParameterSet(x["parameter_set_id"], tuple((p["position"], p.get("type", ""), p["value"]) for p in x.get("parameters", [])))

    def to_json(self) -> dict:
        return {"parameter_set_id": self.parameter_set_id, "parameters": [dict(zip(("position", "type", "value"), p)) for p in self.parameters]}


@dataclass(frozen=True)
class Check:
    """The comparison for one parameter set."""

    parameter_set_id: str
    passed: bool
    method: str
    reason: str = ""
    original_rows: int | None = None
    candidate_rows: int | None = None
    detail: dict = field(default_factory=dict)
    elapsed_ms: float = 0.0


@dataclass(frozen=True)
class Verdict:
    passed: bool
    checks: tuple[Check, ...]
    reason: str = ""


def bound(spark: SparkSession, sql: str, values: ParameterSet) -> DataFrame:
    """The query with this set's values; ValueError if one is missing."""
    types = {int(p.lstrip("$")): t for p, t, _ in values.parameters}
    given = {int(p.lstrip("$")): v for p, _, v in values.parameters}
    args = dialect.bind(types, given, dialect.positions(sql))
    return spark.sql(dialect.to_spark(sql), args=args or None)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the Spark jobs that this block starts, after so many seconds."""
    if not seconds:
        yield
        return
    tag = f"limit-{uuid.uuid4().hex}"
    fired = threading.Event()

    def stop() -> None:
        fired.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if fired.is_set():
            raise TimeoutError(f"more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def comparable(df: DataFrame, epsilon: float) -> DataFrame:
    """Columns by place; floats as buckets of ``epsilon`` (values at a bucket's edge may part: decimals never do); numbers too large for a bucket compare as they are."""
    cells: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"_{i}")
        if isinstance(f.dataType, (DoubleType, FloatType)) and epsilon:
            c = F.when(F.isnan(c) | F.isnull(c) | (F.abs(c) >= F.lit(epsilon * 1e37)), c.cast("string")).otherwise(F.round(c / F.lit(epsilon)).cast("decimal(38,0)").cast("string"))
        cells.append(c.alias(f"_{i}"))
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*cells)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs, with both numbers; empty if the multisets are equal. One exchange, pre-aggregated."""
    names = a.columns
    both = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionAll(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    return both.groupBy(*names).agg(F.sum("_a").alias("in_original"), F.sum("_b").alias("in_candidate")).filter("in_original <> in_candidate")


def sort_keys(sql: str, df: DataFrame) -> list[int] | None:
    """Places of the output columns that a top-level ORDER BY sorts by; None without one, or if a key is not shown."""
    read = sqltext.read(sql)
    body = read.order if read else None
    if read is None and sql.lstrip()[:4].upper() == "WITH":
        ts = sqltext.tokens(sql)
        at = next((t.start for t in reversed(ts) if t.depth == 0 and t.upper == "SELECT"), None)
        read = sqltext.read(sql[at:]) if at is not None else None
        body = read.order if read else None
    if not body:
        return None
    names, out = [c.lower() for c in df.columns], []
    for part in sqltext.split(body, ","):
        key = [t for t in sqltext.tokens(part) if t.upper not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]
        text = "".join(t.text for t in key).strip('"`').lower().split(".")[-1]
        if text.isdigit() and 0 < int(text) <= len(names):
            out.append(int(text) - 1)
        elif text in names:
            out.append(names.index(text))
        else:
            return None
    return out


def with_rank(df: DataFrame, keys: list[int]) -> DataFrame:
    """Rows with ``_run``, the number of their run of equal sort keys, in the order in which they come.

    Runs are counted inside each of the sorted partitions; what the partitions before hold is a table of one row for each
    partition. The sorted rows are persisted, as both sides of that must see the same partitions; ``_gritstone_persisted`` of the result is to be unpersisted.
    """
    cells = F.struct(*[F.col(f"_{k}") for k in keys])
    placed = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).persist(StorageLevel.MEMORY_AND_DISK)
    inner = Window.partitionBy("_part").orderBy("_at")
    new = (~cells.eqNullSafe(F.lag(cells).over(inner)) & (F.row_number().over(inner) > 1)).cast("int")
    counted = placed.withColumn("_new", new).withColumn("_inner", F.sum("_new").over(inner))
    ends = placed.groupBy("_part").agg(F.min_by(cells, "_at").alias("first"), F.max_by(cells, "_at").alias("last"))
    ends = ends.join(counted.groupBy("_part").agg(F.max("_inner").alias("runs")), "_part")
    order = Window.orderBy("_part")  # one row for each partition
    starts = (~F.col("first").eqNullSafe(F.lag("last").over(order)) & (F.row_number().over(order) > 1)).cast("long")
    offsets = ends.withColumn("starts", starts).withColumn("before", F.sum(F.col("starts") + F.col("runs")).over(order) - F.col("runs")).select("_part", "before")
    out = counted.join(F.broadcast(offsets), "_part").withColumn("_run", F.col("before") + F.col("_inner"))
    out = out.select(*df.columns, "_run")
    out._gritstone_persisted = placed
    return out


def compare(spark: SparkSession, original: str, candidate: str, values: ParameterSet, most_rows: int | None, epsilon: float, timeout_s: float | None) -> Check:
    began = time.perf_counter()

    def done(passed: bool, method: str, reason: str = "", rows: tuple = (None, None), **detail) -> Check:
        return Check(values.parameter_set_id, passed, method, reason, *rows, detail, (time.perf_counter() - began) * 1000)

    frames = []
    for side, sql in (("original", original), ("candidate", candidate)):
        try:
            frames.append(bound(spark, sql, values))
        except Exception as e:
            return done(False, "execution", "query_execution_error", side=side, type=type(e).__name__, message=str(e)[:500])
    a, b = frames
    shape = [[(f.name.lower(), f.dataType.simpleString()) for f in x.schema.fields] for x in (a, b)]
    if shape[0] != shape[1]:
        return done(False, "schema", "output_schema_mismatch", original=shape[0], candidate=shape[1])
    side, held = "original", []
    try:
        with time_limit(spark, timeout_s):
            rows = []
            for side, x in (("original", a), ("candidate", b)):
                rows.append(x.limit(most_rows + 1).count() if most_rows is not None else x.count())
            if most_rows is not None and max(rows) > most_rows:
                return done(False, "row_cap", "max_rows_full_compare_exceeded", tuple(rows), cap=most_rows)
            keys = sort_keys(original, a)
            if keys is not None:
                # the order of equal keys is free, so rows are compared as (run of equal keys, row)
                ranked = [with_rank(q.toDF(*[f"_{i}" for i in range(len(q.columns))]), keys) for q in (a, b)]
                held += [q._gritstone_persisted for q in ranked]
                x, y = (comparable(q, epsilon) for q in ranked)
                method, reason = "ordered", "ordered_rows_mismatch"
            else:
                x, y = comparable(a, epsilon), comparable(b, epsilon)
                method, reason = "multiset", "row_multiset_mismatch"
            different = multiset_difference(x, y).limit(10).collect()
    except Exception as e:
        return done(False, "execution", "query_execution_error", side=side, type=type(e).__name__, message=str(e)[:500])
    finally:
        for x in held:
            x.unpersist()
    if different:
        told = [{"row": [str(v) for v in r[:-2]], "in_original": r[-2], "in_candidate": r[-1]} for r in different]
        return done(False, method, reason, tuple(rows), examples=told)
    return done(True, method, "", tuple(rows))


def validate(spark: SparkSession, original: str, candidate: str, sets: list[ParameterSet], most_rows: int | None = 100_000, epsilon: float = 1e-9, timeout_s: float | None = 60.0) -> Verdict:
    """All sets must pass, and there must be one; the first execution error ends it. ``most_rows=None`` compares everything."""
    if not sets:
        return Verdict(False, (), "no_parameter_sets")
    checks: list[Check] = []
    for values in sets:
        checks.append(compare(spark, original, candidate, values, most_rows, epsilon, timeout_s))
        if checks[-1].reason == "query_execution_error":
            break
    passed = all(c.passed for c in checks) and len(checks) == len(sets)
    return Verdict(passed, tuple(checks), next((c.reason for c in checks if not c.passed), ""))


def preflight(spark: SparkSession, original: str, candidate: str, sets: list[ParameterSet]) -> list[Check]:
    """Physical plans of both sides for each set, without running anything; failures only."""
    out = []
    for values in sets:
        for side, sql in (("original", original), ("candidate", candidate)):
            try:
                bound(spark, sql, values)._jdf.queryExecution().executedPlan().toString()
            except Exception as e:
                out.append(Check(values.parameter_set_id, False, "preflight", "typed_preflight_failed", detail={"side": side, "type": type(e).__name__, "message": str(e)[:500]}))
    return out
