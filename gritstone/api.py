"""The engine's services as calls that take and return plain dictionaries, for use in a process or behind a server."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import asdict

from pyspark.sql import SparkSession

from gritstone import __version__
from gritstone.operators import candidates, equivalence
from gritstone.operators.proposer import OfflineProposer, Proposer, ProposerUnavailable
from gritstone.plans.analyze import canonical_hash, parse_and_analyze
from gritstone.sources.catalog import SchemaContext, TableInfo


def context_from_json(x: dict | None) -> SchemaContext:
    """A schema context from its exchange form: tables with columns, nullability, keys and row estimates."""
    tables = {}
    for t in (x or {}).get("tables", []):
        keys = tuple(tuple(c.lower() for c in k["columns"]) for k in t.get("constraints", []) + [i for i in t.get("indexes", []) if i.get("unique")] if k.get("type", "u") in ("p", "u", "primary", "unique"))
        references = tuple((c.lower(), k["referencedTable"].lower(), r.lower()) for k in t.get("constraints", []) if k.get("type") in ("f", "foreign") for c, r in zip(k["columns"], k["referencedColumns"]))
        tables[t["name"].lower()] = TableInfo(t["name"].lower(), {c["name"].lower(): bool(c.get("nullable", True)) for c in t.get("columns", [])}, keys, t.get("rowEstimate"), references)
    return SchemaContext(tables)


def context_to_json(context: SchemaContext) -> dict:
    return {"snapshotHash": context.snapshot_hash, "tables": [{"name": t.name, "rowEstimate": t.rows, "columns": [{"name": c, "nullable": n, "ordinalPosition": i} for i, (c, n) in enumerate(t.columns.items(), 1)], "constraints": [{"type": "unique", "columns": list(k)} for k in t.keys] + [{"type": "foreign", "columns": [c], "referencedTable": other, "referencedColumns": [its]} for c, other, its in t.references]} for t in context.tables.values()]}


class Service:
    """Calls with counters and total times, by name."""

    def __init__(self, spark: SparkSession, proposer: Proposer | None = None):
        self.spark, self.proposer = spark, proposer or OfflineProposer()
        self.calls: Counter = Counter()
        self.seconds: Counter = Counter()

    def _timed(self, name: str, work):
        began = time.perf_counter()
        try:
            return work()
        except Exception:
            self.calls[f"{name}_failed"] += 1
            raise
        finally:
            self.calls[name] += 1
            self.seconds[name] += time.perf_counter() - began

    def parse_and_analyze(self, request: dict) -> dict:
        def work() -> dict:
            a = parse_and_analyze(self.spark, request["sql"], request.get("check_fragment", True))
            return asdict(a) | {"accepted": a.accepted, "canonical_hash": canonical_hash(self.spark, request["sql"])}

        return self._timed("parse_and_analyze", work)

    def generate_candidates(self, request: dict) -> dict:
        def work() -> dict:
            made = candidates.generate(self.spark, request["sql"], context_from_json(request.get("schema_context")), request.get("sources", ("rule", "llm")), request.get("max_candidates", 10), request.get("allowed_rule_families"), self.proposer, request.get("model"))
            return {"candidates": [asdict(c) | {"structurally_valid": c.structurally_valid} for c in made.candidates], "rejected": [asdict(r) for r in made.rejected], "rule_latency_ms": made.rule_ms, "llm_latency_ms": made.model_ms, "provenance": made.provenance}

        return self._timed("generate_candidates", work)

    def validate_equivalence(self, request: dict) -> dict:
        def work() -> dict:
            sets = [equivalence.ParameterSet.from_json(p) for p in request.get("parameter_sets", [])]
            verdict = equivalence.validate(self.spark, request["original_sql"], request["candidate_sql"], sets, request.get("max_rows", 100_000), request.get("float_epsilon", 1e-9), request.get("timeout_s", 60.0))
            return asdict(verdict)

        return self._timed("validate_equivalence", work)

    def health(self) -> dict:
        return {"status": "ok", "version": __version__, "spark": self.spark.version}

    def models(self) -> dict:
        try:
            return {"available": True, "models": self.proposer.models()}
        except ProposerUnavailable as e:
            return {"available": False, "models": [], "reason": str(e)}

    def metrics(self) -> dict:
        return {"calls": dict(self.calls), "seconds": dict(self.seconds)}
