"""The services as dictionaries."""

import pytest

from gritstone.api import Service, context_from_json, context_to_json
from gritstone.sources.catalog import Catalog


def test_service(spark):
    context = Catalog(spark, "/root/testdata/sf0.001").register().schema_context()
    told = context_to_json(context)
    assert context_from_json(told).tables == context.tables and len(told["snapshotHash"]) == 64
    s = Service(spark)
    sql = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
    assert s.parse_and_analyze({"sql": sql})["accepted"]
    (made,) = s.generate_candidates({"sql": sql, "schema_context": told, "sources": ["rule"]})["candidates"]
    assert made["source_detail"] == "rule:not_in_to_not_exists" and made["structurally_valid"] and made["same_optimized_plan"] is False
    assert not s.generate_candidates({"sql": sql, "sources": ["rule"]})["candidates"]  # no facts, no rewrite
    request = {"original_sql": sql, "candidate_sql": made["sql"], "parameter_sets": [{"parameter_set_id": "p", "parameters": []}]}
    assert s.validate_equivalence(request)["passed"] and not s.validate_equivalence(request | {"parameter_sets": []})["passed"]
    with pytest.raises(KeyError):
        s.validate_equivalence({})
    assert s.health()["status"] == "ok" and s.models()["available"] and s.metrics()["calls"]["validate_equivalence"] == 3
