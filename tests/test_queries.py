"""Every query with SQL gives the rows of its SQL."""

import pytest

from panelshift.plans import data_checks, graph_queries, layer_queries, native_queries, panel_queries, release_queries, source_queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
MODULES = (data_checks, release_queries, native_queries, panel_queries, layer_queries, graph_queries, source_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


#: Edits, large panels and lost symbols need not occur in the smallest tables.
SMALL_TABLES_GIVE_NONE = {
    "edit_classes", "edited_graph", "matched_controls", "contrast_bounds", "scale_diagnostic", "changed_leaders", "fixed_layers", "layer_comparison", "ablation_panels", "ablation_summary", "matched_support", "direction_agreement",
    "response_classes", "action_overlap", "native_leader_changes", "prior_symbol_candidates", "control_balance", "edit_features",
}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    rows, mine, theirs = compare(QUERIES[name](spark, FOLDER), ORACLE[name], connection)
    assert not mine and not theirs
    assert rows or name in SMALL_TABLES_GIVE_NONE


def test_names_are_distinct():
    assert len(QUERIES) == sum(len(module.QUERIES) for module in MODULES)
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


#: Queries without SQL: the least rows and a condition that all of them meet.
SHAPES = {
    "p6_suspected_renames": (0, "old_name <> new_name and weight >= 1"),
    "p6_unified_fields": (1, "field_kind in ('role', 'field', 'payload') and (field is not null or field_kind = 'payload')"),
    "held_out_prediction": (1, "rows > 0 and brier between 0 and 1 and coalesce(capture, 0) between 0 and 1"),
    "propagation_converged": (1, "score >= 0"),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql(spark, name):
    least, condition = SHAPES[name]
    rows = QUERIES[name](spark, FOLDER).cache()
    assert rows.count() >= least and rows.filter(f"not coalesce({condition}, false)").count() == 0
