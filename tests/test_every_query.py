"""Every registered query of the library runs on the smallest tables."""

import os

import pytest

from panelwright.plans import all_checks, all_queries

SMALL = "/root/testdata/sf0.001"
# Minutes each; their operators have tests of their own (parents, crossfit, newton, learners).
SLOW = {
    "invariant_parents", "invariance_thresholds", "effects_of_all_treatments", "walk_forward_model", "model_families", "double_ml_forest", "fitted_backtest",
    "fitted_performance", "fitted_causal_graph", "fitted_coherence", "fitted_competency", "fitted_consensus", "fitted_feature_sets", "fitted_stability",
}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query_runs(spark, name):
    out = all_queries()[name](spark, SMALL)
    out.write.format("noop").mode("overwrite").save()
    assert len(out.columns) == len(set(out.columns)) > 0


def test_checks_belong_to_queries():
    assert set(all_checks()) <= set(all_queries())
