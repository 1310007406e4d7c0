"""Every registered query: against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from evkit.plans.catalog import REGISTRY
from tests.check_oracle import compare, open_tables

FOLDER = "/root/testdata/sf0.001"
FITTED = ["logistic_scores", "boosted_scores", "logistic_coefficients", "scenario_scores",
          "model_comparison"]
# Trees are walked by array functions in Arrow batches.
IN_PYTHON = ["boosted_levels"]

# Operators of the inventory that a query exercises. A5 and B22 are shown by all queries and by the
# fitted models; B25 is a column of the summaries.
IDS = (
    [f"A{i}" for i in range(1, 5)]
    + [f"B{i}" for i in range(1, 31)]
    + [f"C{i}" for i in range(1, 8)]
    + [f"D{i}" for i in range(1, 25)]
    + [f"W{i}" for i in range(1, 8)]
    + [f"F{i}" for i in range(1, 6)]
    + ["G1"]
    + [f"L{i}" for i in range(1, 18)]
)


@pytest.fixture(scope="module")
def con():
    return open_tables(FOLDER)


def test_every_operator_has_a_query():
    covered = {i for q in REGISTRY.values() for i in q.ids}
    assert sorted(set(IDS) - covered) == []


def test_only_fitted_models_lack_sql():
    assert sorted(set(REGISTRY) - set(entry.oracle_sql())) == sorted(FITTED)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "team" and df.count() == 25


def plan(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(FITTED) - set(IN_PYTHON)))
def test_plans_stay_in_the_jvm_and_never_pair_everything(spark, name):
    text = plan(spark, name)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["running_tallies_parity", "running_tallies_corrected"])
def test_tallies_take_one_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning(day") == 1
    assert text.count("Exchange ") == 1


def test_summary_aggregates_lines_before_joining(spark):
    text = plan(spark, "over_under_by_nation")
    scan = text[: text.index("lineitem.parquet")]
    assert scan.rindex("partial_sum(xp") > scan.rindex("Join")


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "over_under_by_nation")
    schema = "struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>"
    assert f"ReadSchema: {schema}" in text
    text = plan(spark, "null_policy")
    assert "text:string" not in text and "PushedFilters: [IsNotNull(n_chars)" in text


def test_top_k_does_not_sort_everything(spark):
    for name in ("top_suppliers", "bottom_customers", "largest_parts", "top_brands"):
        text = plan(spark, name)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name", ["cramers_v_lines", "correlation_ratio_lines", "numeric_pairs_lines", "pearson_bundle"])
def test_associations_scan_the_table_once(spark, name):
    assert plan(spark, name).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["game_totals", "region_slice", "season_over_under"])
def test_games_are_summed_before_they_meet_a_join(spark, name):
    text = plan(spark, name)
    above = text[: text.index("lineitem.parquet")]
    assert above.rindex("partial_sum(xp") > above.rindex("Join")


def test_small_dimensions_are_broadcast(spark):
    assert plan(spark, "over_under_by_nation").count("BroadcastHashJoin") >= 2


def test_single_partition_steps_see_aggregates_only(spark):
    """Rows meet in one task only as partial aggregates or as counts per distinct score."""
    for name in ("freq_event_type", "event_kpis", "line_means", "pearson_bundle", "return_lift"):
        for part in plan(spark, name).split("Exchange SinglePartition")[1:]:
            below = part.split("\n")[1]
            assert "Aggregate" in below and "partial" in below, (name, below)
