"""Plan-shape checks for the scale properties the operators promise."""

import __spark_entry__ as E
from conftest import SF001
from scorelab.plans import relations as R


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flagship_scan_reads_only_needed_columns(spark):
    plan = E.queries()["poe_by_model"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    for unused in ("l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey", "l_linestatus"):
        assert unused not in plan


def test_product_of_experts_has_no_lambdas(spark):
    # plain arithmetic keeps the score inside whole-stage codegen
    assert "lambdafunction" not in optimized(R.measurements(spark, SF001)).lower()
    # control: a line-based text metric does show its lambdas in the plan string
    assert "lambdafunction" in optimized(E.queries()["rule_score"](spark, SF001)).lower()


def test_correlations_need_no_join(spark):
    assert "Join" not in optimized(E.queries()["spearman_matrix"](spark, SF001))
    # one aggregate over shifted values: raw rows are not unfolded into pairs
    plan = optimized(E.queries()["pearson_matrix"](spark, SF001))
    assert "explode" not in plan and plan.count("Join") == plan.count("strategy=broadcast") == 1


def test_no_scan_is_dealt_anew(spark):
    for name in ("poe_by_model", "clean_text", "verdict_join", "evaluate_documents"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION" not in plan, name


def test_evaluation_moves_no_text(spark):
    plan = E.queries()["evaluate_documents"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[:-1]     # what stands at or above a join
    assert above and not any("completion#" in part or "text#" in part for part in above)


def test_per_model_normalisation_scans_once(spark):
    for name in ("heatmap_norm", "minmax_norm", "delta_summary"):
        assert optimized(E.queries()[name](spark, SF001)).count("Relation [") == 1, name


def test_a_computed_score_stands_once_in_the_plan(spark):
    """Missing scores are left out by counts; a pushed filter would hold the whole score a second time."""
    from scorelab.operators import agg, positions

    one = optimized(R.measurements(spark, SF001)).count("POWER(")
    scored = R.measurements(spark, SF001)
    for plan in (agg.histogram(scored, "overall_score"), positions.value_counts(scored, "model", "overall_score"), agg.model_means(scored)):
        assert optimized(plan).count("POWER(") == one == 1


def test_lookup_lists_come_from_one_join(spark):
    plan = optimized(E.queries()["task_lookup"](spark, SF001))
    assert plan.count("Join") == 1 and plan.count("Relation [") == 2
