"""Staging of holdings ships the lines once and gives each holding its share of the fund's month."""

from panelwright.plans import views as v

SF = "/root/testdata/sf0.001"


def test_lines_travel_once_and_shares_add_up(spark):
    h = v.build_holdings(spark, SF)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(l_suppkey" in plan
    got = h.groupBy("fund", "period").sum("pct_nav").collect()
    assert got and all(abs(r[2] - 100) < 1e-3 for r in got)
