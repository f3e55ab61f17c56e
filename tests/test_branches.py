"""Rules whose results would be green for any constant: every outcome occurs in the registered queries."""

import pytest
from siltstone.plans import catalogue
from tests.oracle import duck

SF = "/root/testdata/sf0.01"
OUTCOMES = {
    "low_quality": ("low", {True, False}),
    "workload_shape": ("shape", {"conversation", "log_stream", "structured", "unknown"}),
    "layered_route": ("shape", {"conversation", "log_stream", "structured", "unknown"}),
    "query_type": ("kind", {"kw", "vec", "mixed"}),
    "query_complexity": ("is_complex", {True, False}),
    "question_kind": ("kind", {"count", "order", "other"}),
    "json_lenient_parse": ("ok", {True, False}),
    "entity_tiers": ("tier", {1.0, 2.0, 3.0}),
    "plan_order": ("kind", {"lookup", "synthesis"}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_every_outcome_occurs(name):
    column, want = OUTCOMES[name]
    columns, rows = duck(catalogue.oracles()[name], SF)
    assert {r[columns.index(column)] for r in rows} == want


def test_questions_of_both_shapes():
    columns, rows = duck(catalogue.oracles()["question_shapes"], SF)
    assert {r[columns.index("synthesis")] for r in rows} == {True, False}
    assert {r[columns.index("route")] for r in rows} == {"keyword", "hybrid"}


def test_leaks_are_some():
    columns, rows = duck(catalogue.oracles()["leak_rates"], SF)
    assert any(r[columns.index("leaked")] > 0 for r in rows) and any(r[columns.index("kept_a_run")] > 0 for r in rows)
