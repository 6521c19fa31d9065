"""Property graph as two tables and the questions asked of it.

nodes(label, node_id, props) and edges(etype, src_label, src, dst_label, dst,
period, props, attrs). Node and edge types are partitions of the written
tables, so a question about one type reads only its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import periods as pr
from panelwright.functions import rules as ru
from panelwright.operators import skew
from panelwright.operators.macro import union_all
from panelwright.operators.positions import modal_value
from panelwright.session import staged

# Graphs with longer walks than this count as cyclic, and their paths are enumerated.
DEEPEST = 32

# Wording of explanatory groups.
GROUP_DESCRIPTIONS = {
    "price_momentum": "Price & Momentum Signal", "herding": "Cross-Fund Herding Behavior", "position_size": "Position Size & Allocation",
    "risk": "Risk & Volatility Signal", "macro_rates": "Macro Rate Environment", "macro_equity": "Equity Market Condition",
    "sentiment": "News Sentiment Signal", "other": "Other Signal", "fund_decision": "Fund Decision",
}
# Treatments whose effects are not put into the graph, and expected schema parts.
UNRELIABLE = ["nifty50_return", "usd_inr"]
EXPECTED_LABELS = ["Fund", "Stock", "Sector", "TimePeriod", "CausalVariable", "CausalAnalysis", "DomainConcept", "MarketCapStratum"]
EXPECTED_EDGES = ["HOLDS", "BELONGS_TO", "ACTIVE_IN", "NEXT", "GRANGER_CAUSES", "REPRESENTS", "INFLUENCES"]
# Regime thresholds, (high, low-or-moderate) volatility and trend, for raw and z-scored input.
REGIME_CUTS = {"raw": (25.0, 15.0, 3.0), "z": (0.75, -0.50, 0.75)}


def _map(items: dict[str, Column], kind: str) -> Column:
    if not items:
        return F.create_map().cast(f"map<string,{kind}>")
    flat = [x for k, c in items.items() for x in (F.lit(k), c.cast(kind))]
    return F.create_map(*flat)


def node(df: DataFrame, label: str, node_id: Column, **props: Column) -> DataFrame:
    return df.select(F.lit(label).alias("label"), node_id.cast("string").alias("node_id"), _map(props, "string").alias("props"))


def edge(df: DataFrame, etype: str, src: tuple[str, Column], dst: tuple[str, Column], period: Column | None = None, props: dict | None = None, attrs: dict | None = None) -> DataFrame:
    return df.select(
        F.lit(etype).alias("etype"), F.lit(src[0]).alias("src_label"), src[1].cast("string").alias("src"),
        F.lit(dst[0]).alias("dst_label"), dst[1].cast("string").alias("dst"),
        (period if period is not None else F.lit(None)).cast("string").alias("period"),
        _map(props or {}, "double").alias("props"), _map(attrs or {}, "string").alias("attrs"),
    )


def market_regime(volatility: Column, trend: Column, scale: str = "raw") -> tuple[Column, Column]:
    """(volatility level, trend) words; the scale is stated, not guessed from magnitudes."""
    high, low, move = REGIME_CUTS[scale]
    if scale == "raw":
        level = F.when(volatility > high, "HIGH_VOLATILITY").when(volatility > low, "MODERATE_VOLATILITY").otherwise("LOW_VOLATILITY")
    else:
        level = F.when(volatility > high, "HIGH_VOLATILITY").when(volatility < low, "LOW_VOLATILITY").otherwise("MODERATE_VOLATILITY")
    way = F.when(trend > move, "BULL").when(trend < -move, "BEAR").otherwise("SIDEWAYS")
    return F.when(volatility.isNull(), "UNKNOWN").otherwise(level), F.when(trend.isNull(), "UNKNOWN").otherwise(way)


def regimes(months: DataFrame, volatility: str, trend: str, scale: str = "raw") -> DataFrame:
    """One regime per month: (period, regime, level, trend, values)."""
    level, way = market_regime(F.col(volatility), F.col(trend), scale)
    return months.select("period", level.alias("vix_level"), way.alias("market_trend"), F.col(volatility).alias("vix_value"), F.col(trend).alias("market_return")).withColumn(
        "regime", F.concat_ws("_", "vix_level", "market_trend")
    )


def fund_nodes(h: DataFrame) -> DataFrame:
    f = h.groupBy("fund").agg(F.min("fund_type").alias("fund_type"), F.avg("pct_nav").alias("aum_avg"))
    return node(f, "Fund", F.col("fund"), type=F.col("fund_type"), aum_avg=F.col("aum_avg"))


def stock_sector(h: DataFrame) -> DataFrame:
    return modal_value(h.where(F.col("sector").isNotNull()), "isin", "sector")


def stock_nodes(h: DataFrame) -> DataFrame:
    return node(stock_sector(h), "Stock", F.col("isin"), name=F.col("isin"), symbol=F.col("isin"), sector=F.col("sector"))


def period_nodes(h: DataFrame) -> DataFrame:
    p = F.col("period")
    return node(
        h.select("period").distinct(), "TimePeriod", p, year=F.substring(p, 1, 4), month=F.substring(p, 6, 2).cast("int"),
        quarter=pr.quarter_label(p), fiscal_year=pr.fiscal_year(p),
    )


def fund_snapshots(h: DataFrame) -> DataFrame:
    """Stocks held and total weight per fund and month."""
    return h.groupBy("fund", "period").agg(F.countDistinct("isin").alias("total_stocks"), F.sum("pct_nav").alias("total_nav"))


def stock_snapshots(h: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of the numeric columns per stock and month."""
    return h.groupBy("isin", "period").agg(*[F.avg(c).alias(c) for c in cols])


def period_chain(h: DataFrame) -> DataFrame:
    """Each month with its successor (calendar-bounded)."""
    p = h.select("period").distinct()
    return p.withColumn("next_period", F.lead("period").over(W.orderBy("period"))).where(F.col("next_period").isNotNull())


def temporal_nodes(h: DataFrame, regime: DataFrame, snapshot_cols: list[str]) -> DataFrame:
    fs, ss = fund_snapshots(h), stock_snapshots(h, snapshot_cols)
    return union_all([
        node(h.select("sector").where(F.col("sector").isNotNull()).distinct(), "Sector", F.col("sector")),
        fund_nodes(h),
        stock_nodes(h),
        period_nodes(h),
        node(regime.select("regime", "vix_level", "market_trend").distinct(), "MarketRegime", F.col("regime"), regime_type=F.col("regime"), vix_level=F.col("vix_level"), market_trend=F.col("market_trend")),
        node(fs, "FundSnapshot", F.concat_ws("|", "fund", "period"), total_stocks=F.col("total_stocks"), total_nav=F.col("total_nav")),
        node(ss, "StockSnapshot", F.concat_ws("|", "isin", "period"), **{c: F.col(c) for c in snapshot_cols}),
    ])


HOLDS_PROPS = ["pct_nav", "quantity", "market_value", "allocation_change", "holding_tenure", "consensus_count", "monthly_return", "rsi", "sentiment_mean"]


def temporal_edges(h: DataFrame, exits: DataFrame, regime: DataFrame) -> DataFrame:
    """Holdings, exits, sectors, activity, month chain, regimes and snapshot links.

    Endpoints are projections of the same panel the nodes come from, so every
    edge finds both ends.
    """
    fund, stock, period = F.col("fund"), F.col("isin"), F.col("period")
    active = h.groupBy("fund", "period").agg(F.count("*").alias("n"))
    stock_month = h.select("isin", "period").distinct()
    snap_f, snap_s = F.concat_ws("|", "fund", "period"), F.concat_ws("|", "isin", "period")
    return union_all([
        edge(h, "HOLDS", ("Fund", fund), ("Stock", stock), period, {c: F.col(c) for c in HOLDS_PROPS if c in h.columns}, {"position_action": F.col("position_action")}),
        edge(exits, "EXITED", ("Fund", fund), ("Stock", stock), F.col("exit_month"), {"last_pct_nav": F.col("last_pct_nav"), "holding_tenure": F.col("holding_tenure")}),
        edge(stock_sector(h), "BELONGS_TO", ("Stock", stock), ("Sector", F.col("sector"))),
        edge(active, "ACTIVE_IN", ("Fund", fund), ("TimePeriod", period), None, {"holdings_count": F.col("n")}),
        edge(period_chain(h), "NEXT", ("TimePeriod", period), ("TimePeriod", F.col("next_period"))),
        edge(regime, "IN_REGIME", ("TimePeriod", period), ("MarketRegime", F.col("regime")), None, {"vix_value": F.col("vix_value"), "market_return": F.col("market_return")}),
        edge(active, "OF_FUND", ("FundSnapshot", snap_f), ("Fund", fund)),
        edge(active, "AT_TIME", ("FundSnapshot", snap_f), ("TimePeriod", period)),
        edge(stock_month, "OF_STOCK", ("StockSnapshot", snap_s), ("Stock", stock)),
        edge(stock_month, "AT_TIME", ("StockSnapshot", snap_s), ("TimePeriod", period)),
    ])


def causal_nodes(links: DataFrame, parents: DataFrame, effects: DataFrame) -> DataFrame:
    spark = links.sparkSession
    names = union_all([
        links.select(F.col("cause").alias("name")), links.select(F.col("target").alias("name")),
        parents.select(F.col("variable").alias("name")), parents.select(F.col("target").alias("name")),
        effects.select(F.col("treatment").alias("name")), effects.select(F.col("outcome").alias("name")),
        spark.createDataFrame([("position_action",)], "name string"),
    ]).distinct()
    groups = links.select(F.col("cause_group").alias("name")).union(spark.createDataFrame([("fund_decision",)], "name string")).distinct()
    words = F.create_map(*[F.lit(x) for kv in GROUP_DESCRIPTIONS.items() for x in kv])
    run = spark.createDataFrame([("panel_granger_v2",)], "name string")
    return union_all([
        node(names, "CausalVariable", F.col("name")),
        node(groups, "DomainConcept", F.col("name"), description=F.coalesce(words[F.col("name")], F.col("name"))),
        node(run, "CausalAnalysis", F.col("name"), method=F.lit("panel OLS + BH-FDR")),
    ])


def causal_edges(links: DataFrame, parents: DataFrame, effects: DataFrame) -> DataFrame:
    """Evidence edges between variables, concept mapping and concept influence."""
    cv = "CausalVariable"
    g = links.where(F.col("link_type") == "causal")
    a = links.where(F.col("link_type") == "association")
    sign = F.when(F.col("beta") > 0, "positive").otherwise("negative")
    stats = {c: F.col(c) for c in ("beta", "t_stat", "p_value", "partial_r2")}
    concept = links.select("cause", "cause_group").distinct().union(links.sparkSession.createDataFrame([("position_action", "fund_decision")], "cause string, cause_group string"))
    influence = g.groupBy("cause_group").agg(F.count("*").alias("n"), F.max("partial_r2").alias("r2"))
    e = effects.where(~F.col("treatment").isin(*UNRELIABLE))
    return union_all([
        edge(g, "GRANGER_CAUSES", (cv, F.col("cause")), (cv, F.col("target")), None,
             {**stats, "lag": F.col("lag"), "p_fdr": F.col("p_fdr"), "significant": F.col("significant").cast("int"), "n_obs": F.col("n_obs")},
             {"direction": sign, "effect_size": ru.effect_label(F.col("partial_r2")), "cause_group": F.col("cause_group"), "stratum": F.col("stratum")}),
        edge(a, "ASSOCIATED_WITH", (cv, F.col("cause")), (cv, F.col("target")), None, {**stats, "lag": F.lit(0)}, {"cause_group": F.col("cause_group"), "stratum": F.col("stratum")}),
        edge(concept, "REPRESENTS", (cv, F.col("cause")), ("DomainConcept", F.col("cause_group"))),
        edge(influence, "INFLUENCES", ("DomainConcept", F.col("cause_group")), ("DomainConcept", F.lit("fund_decision")), None, {"link_count": F.col("n"), "max_partial_r2": F.col("r2")}),
        edge(parents, "CAUSES", (cv, F.col("variable")), (cv, F.col("target")), None, {"confidence": F.col("confidence"), "in_intersection": F.col("in_intersection").cast("int")}, {"stratum": F.col("stratum"), "confidence_type": F.col("confidence_type")}),
        edge(e, "CAUSAL_EFFECT", (cv, F.col("treatment")), (cv, F.col("outcome")), None, {c: F.col(c).cast("double") for c in ("theta_hat", "std_error", "ci_lower_95", "ci_upper_95", "significant")}, {"direction": F.col("direction")}),
    ])


def bridge_edges(links: DataFrame, periods: DataFrame) -> DataFrame:
    """Strongest link of every significant cause tied to every month.

    The causes come from a hypothesis table (dozens); they ride along as one
    array, so no cross join is needed.
    """
    best = skew.keep_one(links.where("significant"), ["cause"], [F.abs("beta").desc(), F.col("lag"), F.col("target")])
    packed = best.agg(F.collect_list(F.struct("cause", "lag", "beta", "cause_group")).alias("b"))
    rows = periods.select("period").distinct().withColumn("_c", F.explode(packed.scalar())).select("period", "_c.*")
    return edge(rows, "DRIVES_FUND_DECISION", ("CausalVariable", F.col("cause")), ("TimePeriod", F.col("period")), F.col("period"), {"dominant_lag": F.col("lag"), "beta": F.col("beta")}, {"cause_group": F.col("cause_group")})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], latest: list[str] | None = None) -> DataFrame:
    """Merge by key and set properties.

    Of new rows with one key the last stays: by ``latest`` columns, then by
    all others. A property it lacks or has as NULL keeps its old value; rows
    of ``old`` without a new row stay. A NULL in a key is a value.
    """
    rest = [c for c in new.columns if c not in keys]
    order = [F.col(c).desc_nulls_last() for c in [*(latest or []), *rest]]
    one = skew.keep_one(new, keys, order or [F.lit(1)]).withColumnsRenamed({c: f"_new_{c}" for c in new.columns})
    same = F.lit(True)
    for k in keys:
        same = same & old[k].eqNullSafe(one[f"_new_{k}"])
    marked = old.withColumn("_old", F.lit(True)).join(one.withColumn("_new", F.lit(True)), same, "full_outer")
    cols = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    pick = {c: [x for x in ([f"_new_{c}"] if c in new.columns else []) + ([c] if c in old.columns else [])] for c in cols}
    return marked.select(*[(F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in keys else F.coalesce(*pick[c])).alias(c) for c in cols])


# --- counts, quality and questions -------------------------------------------------


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_label").alias("label"), F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("node_id")))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(endpoints(edges).distinct(), ["label", "node_id"], "left_anti")


def metric_rows(row: DataFrame, category: str) -> DataFrame:
    """A one-row aggregate as (category, metric, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]))
    return row.select(F.lit(category).alias("category"), cells.alias("_c")).select("category", "_c.metric", "_c.value")


def structural(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, density, average degree, schema coverage, share of connected nodes."""
    n = nodes.agg(F.count("*").alias("n"), *[F.max((F.col("label") == x).cast("int")).alias(f"l_{x}") for x in EXPECTED_LABELS])
    e = edges.agg(F.count("*").alias("e"), *[F.max((F.col("etype") == x).cast("int")).alias(f"e_{x}") for x in EXPECTED_EDGES])
    one = n.withColumns({"e": e.select("e").scalar(), "iso": isolated(nodes, edges).agg(F.count("*")).scalar(), "rels": e.select(sum(F.col(f"e_{x}") for x in EXPECTED_EDGES)).scalar()})
    v = F.col("n")
    return metric_rows(one.select(
        v.alias("total_nodes"), F.col("e").alias("total_edges"),
        F.coalesce(F.try_divide(F.col("e"), v * (v - 1)), F.lit(0.0)).alias("density"),
        F.coalesce(F.try_divide(2 * F.col("e"), v), F.lit(0.0)).alias("average_degree"),
        (sum(F.col(f"l_{x}") for x in EXPECTED_LABELS) / len(EXPECTED_LABELS)).alias("schema_node_coverage"),
        (F.col("rels") / len(EXPECTED_EDGES)).alias("schema_rel_coverage"),
        F.col("iso").alias("isolated_nodes"), (1 - F.col("iso") / v).alias("connected_ratio"),
    ), "structural")


def entropy(df: DataFrame, col: str) -> DataFrame:
    """Shannon entropy in bits, and divided by its maximum."""
    c = df.groupBy(col).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).scalar()
    s = F.col("n") / total
    return c.agg((-F.sum(s * F.log2(s + 1e-10))).alias("entropy"), F.count("*").alias("k")).select(
        "entropy", F.when(F.col("k") > 1, F.col("entropy") / F.log2(F.col("k").cast("double"))).otherwise(0.0).alias("entropy_normalized")
    )


def sign_consistency(links: DataFrame, stratum: str) -> DataFrame:
    """Share of causes seen in several strata whose mean slope has one sign."""
    per = links.groupBy("cause", stratum).agg(F.signum(F.avg("beta")).alias("s"))
    c = per.groupBy("cause").agg(F.count("*").alias("n"), F.countDistinct("s").alias("signs")).where(F.col("n") >= 2)
    return c.agg(F.avg((F.col("signs") == 1).cast("double")).alias("sign_consistency"), F.count("*").alias("variables_in_multiple_strata"))


def consistency(links: DataFrame, nodes: DataFrame, edges: DataFrame, stratum: str) -> DataFrame:
    g = links.where(F.col("edge_type") == "GRANGER_CAUSES")
    used = endpoints(edges.where(F.col("etype").isin("GRANGER_CAUSES", "ASSOCIATED_WITH"))).distinct()
    cv = nodes.where(F.col("label") == "CausalVariable")
    orphans = cv.join(used, ["label", "node_id"], "left_anti").agg(F.count("*")).scalar()
    one = sign_consistency(g, stratum).withColumns({"t_stat_integrity": g.agg(F.avg((F.abs("strength") > 1.96).cast("double"))).scalar(), "orphan_causal_variables": orphans, "_cv": cv.agg(F.count("*")).scalar()})
    one = one.withColumn("causal_variable_utilization", 1 - F.col("orphan_causal_variables") / F.col("_cv")).drop("_cv")
    return metric_rows(one, "consistency")


def semantic(nodes: DataFrame, edges: DataFrame, panel: DataFrame) -> DataFrame:
    """Coverage of stocks, sectors and months, and balance of concepts."""
    by = nodes.agg(*[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in ("Stock", "TimePeriod", "Fund", "Sector", "MarketRegime")])
    e = edges.agg(
        F.countDistinct(F.when(F.col("etype") == "BELONGS_TO", F.col("src"))).alias("with_sector"),
        F.countDistinct(F.when(F.col("etype") == "ACTIVE_IN", F.col("dst"))).alias("active"),
    )
    ids = panel.select(F.col("isin").alias("node_id")).distinct()
    hit = ids.join(nodes.where(F.col("label") == "Stock").select("node_id"), "node_id", "left_semi")
    ent = entropy(edges.where(F.col("etype") == "REPRESENTS"), "dst")
    one = by.select(
        F.col("Stock").alias("total_stocks"), (e.select("with_sector").scalar() / F.col("Stock")).alias("stock_sector_coverage"),
        (hit.agg(F.count("*")).scalar() / ids.agg(F.count("*")).scalar()).alias("entity_coverage_ratio"),
        ent.select("entropy").scalar().alias("concept_entropy"), ent.select("entropy_normalized").scalar().alias("concept_entropy_normalized"),
        (e.select("active").scalar() / F.col("TimePeriod")).alias("temporal_completeness"), F.col("TimePeriod").alias("total_timepoints"),
        F.col("Fund").alias("total_funds"), F.col("Sector").alias("total_sectors"), F.col("MarketRegime").alias("total_regimes"),
    )
    return metric_rows(one, "semantic")


def informativeness(links: DataFrame) -> DataFrame:
    """Link counts, effect sizes and weighted mean lag."""
    g = F.col("edge_type") == "GRANGER_CAUSES"
    r2 = F.when(g, F.col("partial_r2"))
    return metric_rows(links.agg(
        F.count(F.when(g, 1)).alias("granger_causes_count"), F.count(F.when(~g, 1)).alias("associations_count"), F.count("*").alias("total_causal_edges"),
        F.avg(r2).alias("r2_mean"), F.median(r2).alias("r2_median"), F.max(r2).alias("r2_max"),
        F.count(F.when(r2 >= 0.02, 1)).alias("above_small"), F.count(F.when(r2 >= 0.06, 1)).alias("above_medium"), F.count(F.when(r2 >= 0.14, 1)).alias("above_large"),
        F.avg(F.when(g, F.col("lag"))).alias("avg_lag"), F.countDistinct(F.when(g, F.col("cause"))).alias("unique_causes"),
    ), "informativeness")


def temporal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Holdings per fund and month, totals, and whether the month chain is whole."""
    per = edges.where(F.col("etype") == "HOLDS").groupBy("src", "period").agg(F.count("*").alias("n"))
    one = per.agg(F.avg("n").alias("avg_stocks_per_fund_month"), F.min("n").alias("min_stocks"), F.max("n").alias("max_stocks"), F.sum("n").alias("total_holds"))
    c = edges.agg(F.count(F.when(F.col("etype") == "EXITED", 1)).alias("x"), F.count(F.when(F.col("etype") == "NEXT", 1)).alias("c"))
    tp = nodes.where(F.col("label") == "TimePeriod").agg(F.count("*")).scalar()
    one = one.withColumns({"total_exits": c.select("x").scalar(), "chain_complete": (c.select("c").scalar() == tp - 1).cast("int")})
    return metric_rows(one, "temporal")


def competency(edges: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Ten questions as named aggregates over the edge table, with an answered flag.

    The causal edges are scanned once for the nine causal questions.
    """
    g = edges.where(F.col("etype") == "GRANGER_CAUSES").select(
        "src", "dst", F.col("props")["lag"].alias("lag"), F.col("props")["beta"].alias("beta"), F.col("props")["p_fdr"].alias("p"), F.col("props")["t_stat"].alias("t"), F.col("attrs")[stratum].alias("stratum")
    )
    main = F.col("dst") == "action_ordinal"
    macro = F.col("src").rlike("^(cpi|repo|us_10y|index|vix|nifty|india_vix)")
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    a = g.agg(
        n(main & (F.col("lag") == 1) & (F.col("beta") > 0)).alias("q01"), n(main & (F.col("beta") < 0) & (F.col("p") < 0.01)).alias("q02"),
        F.countDistinct("stratum").cast("double").alias("q03"), F.countDistinct(F.when(macro, F.col("src"))).cast("double").alias("q04"),
        n(F.startswith("src", F.lit("sentiment"))).alias("q05"), F.max(F.abs("t")).alias("q06"), F.countDistinct("lag").cast("double").alias("q09"),
    )
    single = g.groupBy("src").agg(F.countDistinct("stratum").alias("k")).where(F.col("k") == 1).agg(F.count("*").cast("double")).scalar()
    rest = edges.agg(F.count("*").cast("double").alias("q10"), n((F.col("etype") == "INFLUENCES") & (F.col("dst") == "fund_decision")).alias("q07"))
    a = a.withColumns({"q08": single, "q07": rest.select("q07").scalar(), "q10": rest.select("q10").scalar()})
    cols = [f"q{i:02d}" for i in range(1, 11)]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("question"), F.col(c).alias("value")) for c in cols]))
    return a.select(rows.alias("_r")).select("_r.*").withColumn("answered", F.coalesce(F.col("value") > 0, F.lit(False)))


def overall_quality(metrics: DataFrame, questions: DataFrame) -> DataFrame:
    """Mean of the component scores that apply."""
    picks = {
        "total_nodes": "struct_size", "schema_node_coverage": "schema_nodes", "schema_rel_coverage": "schema_rels", "connected_ratio": "connected",
        "sign_consistency": "sign_consistency", "causal_variable_utilization": "var_utilization", "temporal_completeness": "temporal_complete",
        "entity_coverage_ratio": "entity_coverage", "concept_entropy_normalized": "concept_diversity",
    }
    names = F.create_map(*[F.lit(x) for kv in picks.items() for x in kv])
    c = metrics.where(F.col("metric").isin(*picks)).select(names[F.col("metric")].alias("component"), "value")
    size = F.col("component") == "struct_size"
    c = c.where(F.col("value").isNotNull() & ~(size & (F.col("value") <= 100))).withColumn("value", F.when(size, F.least(F.lit(1.0), F.col("value") / 10000)).otherwise(F.col("value")))
    c = c.unionByName(questions.agg(F.avg(F.col("answered").cast("double")).alias("value")).withColumn("component", F.lit("inferential")))
    return c.unionByName(c.agg(F.avg("value").alias("value")).withColumn("component", F.lit("overall")))


def paths(edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """All directed paths of 1..max_hops edges that use no edge twice and end elsewhere than they start."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(">", "src", "dst").alias("eid"))
    cur = e.select(F.array("a", "b").alias("chain"), F.array("eid").alias("used"), F.col("b").alias("tip"))
    parts = [cur]
    for _ in range(max_hops - 1):
        nxt = cur.join(e, cur["tip"] == e["a"]).where(~F.array_contains("used", F.col("eid")))
        cur = nxt.select(F.array_append("chain", F.col("b")).alias("chain"), F.array_append("used", F.col("eid")).alias("used"), F.col("b").alias("tip"))
        parts.append(cur)
    out = union_all(parts).select("chain", (F.size("chain") - 1).alias("length"))
    return out.where(F.element_at("chain", 1) != F.element_at("chain", -1))


def is_acyclic(edges: DataFrame, most: int = DEEPEST) -> bool:
    """Whether no walk of ``most`` edges exists: steps on sets of nodes until none is left."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    front = e.select("b").distinct()
    for _ in range(most):
        front = staged(front.join(e.withColumnRenamed("b", "_next"), front["b"] == e["a"]).select(F.col("_next").alias("b")).distinct(), "front", uuid.uuid4().hex)
        if front.isEmpty():
            return True
    return False


def path_summaries(edges: DataFrame, max_hops: int = 4, k: int = 1) -> DataFrame:
    """(tip, length, n, chains): the number of paths of every length that end in a node, and the ``k`` first chains.

    Without cycles every walk is a path, so one join and one aggregation per
    hop carry counts and the best chains; there are at most nodes x hops rows,
    however many paths they stand for. With cycles, paths are enumerated and
    those that repeat an edge or end where they start fall away.
    """
    if not is_acyclic(edges):
        chains = paths(edges, max_hops).select(F.element_at("chain", -1).alias("tip"), "length", F.concat_ws(" > ", "chain").alias("chain"), F.lit(1).cast("long").alias("n"))
        n = chains.groupBy("tip", "length").agg(F.sum("n").alias("n"))
        best = skew.top_k(chains.select("tip", "length", "chain"), ["tip", "length"], [F.col("chain")], k)
    else:
        e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        count = e.groupBy(F.col("b").alias("tip")).agg(F.count("*").alias("n"))
        chain = e.select(F.col("b").alias("tip"), F.concat_ws(" > ", "a", "b").alias("chain"))
        counts, bests = [], []
        for hop in range(1, max_hops + 1):
            if hop > 1:
                count = count.join(e, F.col("tip") == F.col("a")).groupBy("b").agg(F.sum("n").alias("n")).withColumnRenamed("b", "tip")
                chain = chain.join(e, F.col("tip") == F.col("a")).select(F.col("b").alias("tip"), F.concat_ws(" > ", "chain", "b").alias("chain"))
            chain = skew.top_k(chain, ["tip"], [F.col("chain")], k).select("tip", "chain")
            counts.append(count.withColumn("length", F.lit(hop)))
            bests.append(chain.withColumn("length", F.lit(hop)))
        n, best = union_all(counts), union_all(bests)
    best = best.groupBy("tip", "length").agg(F.sort_array(F.collect_list("chain")).alias("chains"))  # k chains
    return n.join(best, ["tip", "length"]).select("tip", "length", "n", "chains")


def longest_paths(edges: DataFrame, max_hops: int = 4, k: int = 3) -> DataFrame:
    p = path_summaries(edges, max_hops, k).select(F.explode("chains").alias("chain"), "length")
    return p.orderBy(F.desc("length"), "chain").limit(k)


def cause_effect_matrix(links: DataFrame, effects: list[str]) -> DataFrame:
    """Strongest absolute t of each cause per effect, effects as columns."""
    return links.groupBy("cause").pivot("effect", effects).agg(F.max(F.abs("strength")))
