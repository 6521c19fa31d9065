"""The supplied tables re-read as the panel domain (funds, stocks, months, bars, news, macro).

Every view is derived from the tables under ``sf_dir`` so its size follows
theirs. ``holdings`` and the tables built on it are written once per
application to the shared folder because many queries read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import cleaning as cl
from panelwright.functions import periods as pr
from panelwright.functions.encodings import action_class
from panelwright.operators import bars as br
from panelwright.operators import counted as ct
from panelwright.operators import crossfit as cf
from panelwright.operators import effects as ef
from panelwright.operators import egonet as eg
from panelwright.operators import features as ft
from panelwright.operators import granger as gr
from panelwright.operators import graph as gp
from panelwright.operators import invariance as iv
from panelwright.operators import newton as nw
from panelwright.operators import parents as ip
from panelwright.operators import regression as rg
from panelwright.operators import positions as ps
from panelwright.operators import sentiment as st
from panelwright.operators import sweep as sw
from panelwright.operators.macro import union_all
from panelwright.session import is_staged, staged

SECTORS = ["FINANCIAL SERVICES", "INFORMATION TECHNOLOGY", "HEALTHCARE", "ENERGY", "AUTOMOBILE", "FMCG"]
FUND_TYPES = ["small cap", "mid cap", "large cap"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def isin_of(number: Column) -> Column:
    return F.concat(F.lit("INE"), F.lpad(number.cast("string"), 3, "0"))


def brand_number(brand: Column) -> Column:
    return F.replace(brand, F.lit("Brand#"), F.lit("")).cast("int")


def sector_of(isin: Column) -> Column:
    n = F.substring(isin, 4, 3).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), F.pmod(n, F.lit(len(SECTORS))) + 1)


def once(spark, sf_dir: str, name: str, build, partition_by: str | None = None) -> DataFrame:
    got = is_staged(spark, name, sf_dir)
    return got if got is not None else staged(build(), name, sf_dir, partition_by)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its stock and month."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), isin_of(brand_number(F.col("p_brand"))).alias("isin"), "p_retailprice"
    )
    li = table(spark, sf_dir, "lineitem")
    return li.join(part, "l_partkey").withColumns(
        {"period": pr.period_key(F.col("l_shipdate")), "month_ord": pr.month_ordinal(F.col("l_shipdate"))}
    )


def build_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fund, stock and month; lines travel once, by fund and month, before any other join."""
    agg = (
        lines(spark, sf_dir)
        .select("l_suppkey", "isin", "period", "month_ord", "l_quantity", "l_extendedprice")
        .repartition("l_suppkey", "period")
        .groupBy("l_suppkey", "isin", "period", "month_ord")
        .agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("market_value"))
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.col("s_name").alias("fund"),
        F.element_at(
            F.array(*[F.lit(t) for t in FUND_TYPES]), F.pmod(F.col("s_nationkey"), F.lit(3)) + 1
        ).alias("fund_type"),
    )
    total = F.sum("market_value").over(W.partitionBy("l_suppkey", "period"))  # one row per stock, so no more than there are stocks
    return (
        agg.withColumn("_total", total)
        .where(F.col("l_suppkey").isNotNull() & F.col("period").isNotNull())
        .join(supplier, "l_suppkey")
        .select(
            "fund",
            "isin",
            "period",
            "month_ord",
            "quantity",
            "market_value",
            F.round(100.0 * F.col("market_value") / F.round("_total", 2), 6).alias("pct_nav"),
            sector_of(F.col("isin")).alias("sector"),
            "fund_type",
        )
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "holdings", lambda: build_holdings(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "classified", lambda: ps.classify_positions(holdings(spark, sf_dir)))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per stock."""

    def build():
        trades = lines(spark, sf_dir).select(
            F.col("isin").alias("symbol"),
            F.to_date("l_shipdate").alias("date"),
            "period",
            "month_ord",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        return br.ohlc(trades, ["symbol", "date", "period", "month_ord"], order, "price", "qty")

    return once(spark, sf_dir, "bars", build)


def daily_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        b = bars(spark, sf_dir)
        return br.window_indicators(b).join(br.recursive_indicators(b), ["symbol", "date"], "left")

    return once(spark, sf_dir, "daily_indicators", build)


def monthly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "monthly_indicators", lambda: br.monthly_rollup(daily_indicators(spark, sf_dir)))


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored headlines; class weights by fixed arithmetic on type and value."""
    ev = table(spark, sf_dir, "events")
    base = cl.to_map(
        {"purchase": 6.0, "signup": 4.0, "click": 3.0, "view": 2.0, "error": 1.0}, F.col("event_type"), 1.0
    )
    cents = F.round(F.col("value") * 100).cast("long")
    a = base
    b = F.pmod(cents, F.lit(5)).cast("double") + 1.0
    c = F.pmod(F.col("event_id"), F.lit(4)).cast("double")
    day = F.dayofmonth("ts")
    return st.add_score_fields(
        ev.select(
            "event_id",
            isin_of(F.pmod(F.col("user_id"), F.lit(25)) + 1).alias("isin"),
            F.col("ts"),
            day.alias("day"),
            F.hour("ts").alias("hour"),
            pr.ordinal_period(F.lit(1995 * 12 + 1) + 2 * (day - 1)).alias("period"),
            "event_type",
            (a / (a + b + c)).alias("positive_prob"),
            (b / (a + b + c)).alias("negative_prob"),
            (c / (a + b + c)).alias("neutral_prob"),
        )
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period sentiment per stock with momentum, reversal and the low-count rule."""

    def build():
        agg = st.period_sentiment(scored_news(spark, sf_dir), ["isin", "period"], "hour")
        return st.null_thin_periods(st.add_momentum_reversal(agg, "isin", "period"))

    return once(spark, sf_dir, "sentiment", build)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", isin_of(F.pmod(F.col("doc_id"), F.lit(25)) + 1).alias("isin"), "text", "lang", "source"
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order month: level, change, variation coefficient and a rate."""

    def build():
        o = table(spark, sf_dir, "orders")
        m = o.groupBy(
            pr.period_key(F.col("o_orderdate")).alias("period"), pr.month_ordinal(F.col("o_orderdate")).alias("month_ord")
        ).agg(
            # Whole cents keep the mean exact whatever the order of the partial sums.
            (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (100.0 * F.count("*"))).alias("index_close"),
            F.round(100 * F.stddev_samp("o_totalprice") / F.avg("o_totalprice"), 6).alias("vix"),
        )
        w = W.orderBy("month_ord")  # one row per calendar month
        k = F.pmod(F.col("month_ord"), F.lit(7)).cast("double")
        return m.withColumns(
            {
                "index_return": F.round(F.col("index_close") / F.lag("index_close").over(w) - 1, 8),
                "repo_rate": 4.0 + 0.25 * k,
                "cpi": 5.0 + 0.5 * F.pmod(F.col("month_ord"), F.lit(5)).cast("double"),
            }
        )

    return once(spark, sf_dir, "macro", build)


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios per stock and month; every seventh (stock, month) is left out on purpose."""

    def build():
        f = (
            lines(spark, sf_dir)
            .groupBy("isin", "period", "month_ord")
            .agg(
                F.round(F.avg("p_retailprice") / F.avg("l_quantity"), 6).alias("pe"),
                F.round(F.avg(F.col("l_discount") + F.col("l_tax")) * 10, 8).alias("pb"),
                F.round(F.sum("l_extendedprice"), 2).alias("market_cap"),
                F.round(F.avg("l_tax") * 100, 6).alias("eps"),
            )
        )
        n = F.substring("isin", 4, 3).cast("int")
        return f.where(F.pmod(n + F.col("month_ord"), F.lit(7)) != 0)

    return once(spark, sf_dir, "fundamentals", build)


INDICATORS = ["rsi", "macd_hist", "bollinger_pband", "monthly_return", "monthly_volatility", "volume_ratio"]
FUNDAMENTALS = ["pe", "pb", "market_cap", "eps"]
MACRO = ["index_close", "index_return", "vix", "repo_rate", "cpi"]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions joined with indicators, sentiment, fundamentals and macro series.

    The right sides are unique per (stock, month) or month by construction, so
    the row count is that of the decisions.
    """

    def build():
        c = classified(spark, sf_dir).select(
            "fund", "isin", "period", "month_ord", "sector", "fund_type", "quantity", "market_value", "pct_nav",
            "position_action", "allocation_change", "holding_tenure",
        )
        stock = (
            c.groupBy("isin", "period")
            .agg(F.count("*").alias("consensus_count"))
            .join(monthly_indicators(spark, sf_dir).withColumnRenamed("symbol", "isin").select("isin", "period", *INDICATORS), ["isin", "period"], "left")
            .join(sentiment(spark, sf_dir).select("isin", "period", "sentiment_mean", "news_count"), ["isin", "period"], "left")
            .join(fundamentals(spark, sf_dir).select("isin", "period", *FUNDAMENTALS), ["isin", "period"], "left")
            .join(macro(spark, sf_dir).select("period", *MACRO), "period", "left")
        )
        return c.join(stock, ["isin", "period"], "left")

    return once(spark, sf_dir, "panel", build)


def id_map_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First id map: brands up to 17, some names missing."""
    n = brand_number(F.col("p_brand"))
    p = table(spark, sf_dir, "part").groupBy(n.alias("n")).agg(F.count("*").alias("parts")).where(F.col("n") <= 17)
    return p.select(
        isin_of(F.col("n")).alias("isin"),
        F.when(F.col("n") % 5 != 0, F.concat(F.lit("SYM"), F.col("n"))).alias("symbol"),
        F.when(F.col("n") % 4 != 0, F.concat(F.lit("Company "), F.col("n"))).alias("stock_name"),
    )


def id_map_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second id map: brands from 9 on, with its own names."""
    n = brand_number(F.col("p_brand"))
    p = table(spark, sf_dir, "part").groupBy(n.alias("n")).agg(F.count("*").alias("parts")).where(F.col("n") >= 9)
    return p.select(
        isin_of(F.col("n")).alias("isin"),
        F.concat(F.lit(" nse"), F.col("n")).alias("symbol"),
        F.concat(F.lit("Co. "), F.col("n")).alias("stock_name"),
    )


STOCK_VARS = ["monthly_return", "rsi", "bollinger_pband", "macd_hist", "volume_ratio", "monthly_volatility"]
FUND_VARS = ["holding_tenure", "consensus_count", "pct_nav"]
MACRO_VARS = ["index_return", "vix", "cpi"]
CAUSES = [*STOCK_VARS, *FUND_VARS, "sentiment_mean", *MACRO_VARS]
LAGS = [0, 1, 2, 3, 4, 5, 6]


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions pooled to stock and month with market states."""

    def build():
        p = gr.pooled_panel(panel(spark, sf_dir), STOCK_VARS, FUND_VARS, MACRO_VARS, news_floor=10)
        return gr.add_regimes(p, "index_return", "vix", "cpi")

    return once(spark, sf_dir, "pooled", build)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-regressor fixed-effects links of every target, cause and lag (the check fixture)."""

    def build():
        return gr.all_links(gr.sweep(pooled(spark, sf_dir), gr.TARGETS, CAUSES, LAGS, {t: 0 for t in gr.TARGETS}, min_obs=100))

    return once(spark, sf_dir, "links", build)


EVIDENCE = ["rsi", "monthly_return", "volume_ratio", "holding_tenure", "consensus_count", "pct_nav", "sentiment_mean", "pe", "vix", "cpi"]
OUTCOMES = ["action_ordinal", "is_buy", "is_sell"]


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with the numeric targets."""
    a = action_class(F.col("position_action"))
    return panel(spark, sf_dir).withColumns(
        {
            "action_ordinal": a.cast("double"),
            "is_buy": (a == 2).cast("double"),
            "is_sell": (a == 0).cast("double"),
        }
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in parent table per stratum from absolute correlations (same columns as the search result)."""

    def build():
        d = decisions(spark, sf_dir).withColumn("stratum", F.replace("fund_type", F.lit(" "), F.lit("_")))
        aggs = [F.corr(c, "action_ordinal").alias(c) for c in EVIDENCE]
        row = d.groupBy("stratum").agg(*aggs, F.count("*").alias("n_obs"))
        item = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("r")) for c in EVIDENCE]))
        conf = F.round(F.least(F.abs("r") * 8, F.lit(0.99)), 4)
        return row.select("stratum", "n_obs", item.alias("_i")).select(
            "stratum", F.lit("action_ordinal").alias("target"), F.col("_i.variable").alias("variable"), F.col("_i.r").alias("r"), "n_obs"
        ).withColumn("confidence", conf).withColumns(
            {
                "in_intersection": F.col("confidence") >= 0.8,
                "confidence_type": F.when(F.col("confidence") >= 0.8, "certified").when(F.col("confidence") >= 0.3, "plausible").otherwise("soft"),
            }
        ).drop("r")

    return once(spark, sf_dir, "parents", build)


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bivariate effect of every variable on every outcome (same columns as the cross-fitted result)."""

    def build():
        d = decisions(spark, sf_dir)
        cells = F.explode(
            F.array(*[
                F.struct(F.lit(t).alias("treatment"), F.lit(o).alias("outcome"), F.col(t).cast("double").alias("x"), F.col(o).alias("y"))
                for t in EVIDENCE for o in OUTCOMES
            ])
        )
        m = d.select(cells.alias("_c")).select("_c.*").where(F.col("x").isNotNull()).groupBy("treatment", "outcome").agg(
            F.count("*").alias("n_obs"), F.regr_slope("y", "x").alias("theta_hat"), F.regr_r2("y", "x").alias("r2"),
            F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        )
        m = m.withColumn("std_error", F.sqrt(F.col("vy") * (1 - F.col("r2")) / (F.col("vx") * (F.col("n_obs") - 2))))
        lo, hi = F.col("theta_hat") - 1.96 * F.col("std_error"), F.col("theta_hat") + 1.96 * F.col("std_error")
        return m.drop("r2", "vx", "vy").withColumns(
            {
                "ci_lower_95": lo, "ci_upper_95": hi, "significant": (lo > 0) | (hi < 0),
                "direction": F.when(F.col("theta_hat") > 0, "positive").otherwise("negative"),
            }
        )

    return once(spark, sf_dir, "effects", build)


# Candidate columns of the searches beside the panel's own.
READY = {
    "stock_lags": {"rsi": [1], "monthly_return": [1, 2], "sentiment_mean": [1], "eps": [1]},
    "position_lags": {"pct_nav": [1], "allocation_change": [1, 2]},
    "products": {"pe_x_return": ("pe", "monthly_return"), "rsi_x_return": ("rsi", "monthly_return"), "vix_x_return": ("vix", "monthly_return"), "sentiment_x_return": ("sentiment_mean", "monthly_return")},
    "roots": ["log_market_cap", "log_pe", "sqrt_volatility", "log_volume_ratio"],
}
NUMERIC = [
    "holding_tenure", *INDICATORS, "sentiment_mean", "news_count", *FUNDAMENTALS, *MACRO,
    *[f"{c}_lag{k}" for part in ("stock_lags", "position_lags") for c, ks in READY[part].items() for k in ks], *READY["products"], *READY["roots"],
]
# Candidates that domain knowledge favours.
DOMAIN = [
    "pe", "pb", "eps", "eps_lag1", "market_cap", "sentiment_mean", "sentiment_mean_lag1", "repo_rate", "cpi", "vix", "index_return", "holding_tenure",
    "allocation_change_lag1", "allocation_change_lag2", "pct_nav_lag1", "volume_ratio", "rsi_lag1", "pe_x_return", "rsi_x_return", "vix_x_return",
    "sentiment_x_return", "log_market_cap", "log_pe", "sqrt_volatility", "log_volume_ratio", "monthly_return", "monthly_return_lag1", "monthly_return_lag2",
]
# Classes of the ordinal target (sell, hold, buy) as each target sees them.
CLASSES = {"action_ordinal": [0, 1, 2], "is_buy": [0, 0, 1], "is_sell": [1, 0, 0]}


def stratified_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled panel, and beside it one pooled within each fund type, told apart by ``stratum``."""

    def build():
        whole = pooled(spark, sf_dir)
        d = panel(spark, sf_dir).withColumn("stratum", F.replace("fund_type", F.lit(" "), F.lit("_")))
        parts = gr.pooled_panel(d, STOCK_VARS, FUND_VARS, MACRO_VARS, news_floor=10, by=["stratum"])
        states = whole.groupBy("period").agg(*[F.max(c).alias(c) for c in REGIMES])
        return whole.withColumn("stratum", F.lit(ip.POOLED)).unionByName(parts.join(F.broadcast(states), "period", "left"))  # one row per month

    return once(spark, sf_dir, "stratified_panel", build)


REGIMES = ["regime_bull", "regime_hvix", "regime_hcpi"]


def ar_orders(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Autoregressive order of every target by AIC on the pooled panel."""

    def build():
        p = pooled(spark, sf_dir)
        return spark.createDataFrame([(t, gr.select_ar_order(p, t)) for t in gr.TARGETS], "target string, ar_order int")

    return {r["target"]: r["ar_order"] for r in once(spark, sf_dir, "ar_orders", build).collect()}


def stratum_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every stratum with one autoregressive control."""

    def build():
        return sw.all_links(sw.sweep(stratified_panel(spark, sf_dir), gr.TARGETS, CAUSES, LAGS, {t: 1 for t in gr.TARGETS}, 100))

    return once(spark, sf_dir, "stratum_links", build)


def fitted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every target, cause, lag and stratum with autoregressive controls of the chosen order."""

    def build():
        return sw.all_links(sw.sweep(stratified_panel(spark, sf_dir), gr.TARGETS, CAUSES, LAGS, ar_orders(spark, sf_dir), 100))

    return once(spark, sf_dir, "fitted_links", build)


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with every candidate column: lags of stocks and positions, products and roots."""

    def build():
        d = decisions(spark, sf_dir)
        lags = READY["stock_lags"]
        s = ft.stock_frame(d, [*lags])
        for c, ks in lags.items():
            s = ft.add_lags(s, ["isin"], "period", [c], ks)
        for c, ks in READY["position_lags"].items():
            d = ft.add_lags(d, ["fund", "isin"], "month_ord", [c], ks)
        d = d.join(F.broadcast(s.drop(*lags)), ["isin", "period"], "left")  # stocks x months
        return d.withColumns(ft.nonlinear() | ft.interactions(READY["products"])).withColumn("stratum", F.replace("fund_type", F.lit(" "), F.lit("_")))

    return once(spark, sf_dir, "ready", build)


# Candidate columns that are not those of the stock and month: of few values (months), and of many.
FEW_VALUES = ["holding_tenure"]
DENSE = ["pct_nav_lag1", "allocation_change_lag1", "allocation_change_lag2"]


def counted(spark: SparkSession, sf_dir: str) -> ct.Counted:
    """``ready`` counted by stratum, stock, month, outcomes and tenure, with sums of the dense columns."""
    keys, shared = ["isin", "period"], [c for c in NUMERIC if c not in FEW_VALUES + DENSE]
    build = lambda: ct.count_rows(ready(spark, sf_dir), ["stratum", *OUTCOMES], keys, shared, FEW_VALUES, DENSE)
    return ct.Counted(once(spark, sf_dir, "counted", build), keys, shared, FEW_VALUES, DENSE)


def blankets(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Markov blanket of every target over all candidate columns."""

    def build():
        r = ready(spark, sf_dir)
        moments = iv.PatternMoments(r, [*OUTCOMES, *NUMERIC], counted=counted(spark, sf_dir))
        rows = [(t, i, c) for t in OUTCOMES for i, c in enumerate(iv.markov_blanket(r, t, NUMERIC, covariances=moments))]
        return spark.createDataFrame(rows, "target string, pos int, variable string")

    out: dict[str, list[str]] = {t: [] for t in OUTCOMES}
    for r in once(spark, sf_dir, "blankets", build).orderBy("target", "pos").collect():  # targets x at most 40
        out[r["target"]].append(r["variable"])
    return out


def fitted_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents by subset search over 30 candidates, every stratum, target and threshold."""

    def build():
        found = ip.search_all(
            ready(spark, sf_dir), OUTCOMES, NUMERIC, "stratum", "index_return", DOMAIN, merge=CLASSES, blankets=blankets(spark, sf_dir),
            counted=counted(spark, sf_dir),
        )
        return ip.parent_table(spark, found, iv.ALPHAS)

    return once(spark, sf_dir, "fitted_parents", build)


# Treatments that come first.
CORE_TREATMENTS = ["rsi", "monthly_return", "pe", "pb", "sentiment_mean", "repo_rate", "cpi", "vix", "volume_ratio", "holding_tenure"]


def fitted_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-fitted effects of the whole treatment list on the three outcomes, flagged against the fitted parents."""

    def build():
        r = ready(spark, sf_dir)
        found = blankets(spark, sf_dir)
        treatments = ef.treatment_list(r, CORE_TREATMENTS, NUMERIC, sorted({c for cs in found.values() for c in cs}), counted=counted(spark, sf_dir))
        allowed = [c for c in NUMERIC if c not in ef.LEAK]
        est = cf.all_effects(r, treatments, OUTCOMES, allowed, ["fund", "isin", "period"], counted=counted(spark, sf_dir))
        return ef.flag_certified(est, fitted_parents(spark, sf_dir).where(F.col("alpha") == iv.ALPHA_PRIMARY))

    return once(spark, sf_dir, "fitted_effects", build)


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fitted links, parents at the primary threshold, and effects."""
    p = fitted_parents(spark, sf_dir).where(F.col("alpha") == iv.ALPHA_PRIMARY).drop("alpha")
    return fitted_links(spark, sf_dir), p, fitted_effects(spark, sf_dir)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic predictors of every decision in long form."""

    def build():
        c = classified(spark, sf_dir).select("fund", "isin", "period", "month_ord", action_class(F.col("position_action")).alias("actual"))
        w = W.partitionBy("fund", "isin").orderBy("month_ord")
        n = F.substring("isin", 4, 3).cast("int")
        guess = F.array(
            F.struct(F.lit("previous").alias("model"), F.coalesce(F.lag("actual").over(w), F.lit(1)).alias("predicted")),
            F.struct(F.lit("rule").alias("model"), F.pmod(n * 7 + F.col("month_ord") * 5 + F.length("fund"), F.lit(3)).cast("int").alias("predicted")),
            F.struct(F.lit("hold").alias("model"), F.lit(1).alias("predicted")),
        )
        return c.withColumn("_g", guess).select("fund", "isin", "period", "month_ord", "actual", F.explode("_g").alias("_p")).select(
            "_p.model", "fund", "isin", "period", "month_ord", "actual", "_p.predicted"
        )

    return once(spark, sf_dir, "predictions", build)


# Columns that are not those of the stock and month; tenures are few, so the short model counts equal rows.
OWN_COLUMNS = ["holding_tenure", "pct_nav_lag1", "allocation_change_lag1", "allocation_change_lag2"]
MODEL_COLUMNS = ["rsi", "monthly_return", "volume_ratio", "pe", "sentiment_mean", "vix", "holding_tenure"]


def fitted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward predictions of two softmax models: chosen columns, and every candidate column."""

    def build():
        r = ready(spark, sf_dir)
        keep = ["fund", "isin", "period", "month_ord"]
        models = (("logistic", MODEL_COLUMNS, []), ("logistic_all", NUMERIC, OWN_COLUMNS))
        return union_all([nw.walk_forward(r, cols, "action_ordinal", keep, n, embargo=1, own=own) for n, cols, own in models])

    return once(spark, sf_dir, "fitted_predictions", build)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised return per stock and month, one row each; some months unknown."""
    m = monthly_indicators(spark, sf_dir).select(F.col("symbol").alias("isin"), "period", F.col("monthly_return").alias("real_return"))
    return m.where(F.substring("period", 6, 2) != "07")


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market regime per month on z-scored volatility and return."""

    def build():
        m = panel(spark, sf_dir).groupBy("period").agg(F.max("vix").alias("v"), F.max("index_return").alias("r"))
        s = m.agg(F.avg("v").alias("mv"), F.stddev_samp("v").alias("sv"), F.avg("r").alias("mr"), F.stddev_samp("r").alias("sr"))
        z = m.select(
            "period",
            ((F.col("v") - s.select("mv").scalar()) / s.select("sv").scalar()).alias("vix_z"),
            ((F.col("r") - s.select("mr").scalar()) / s.select("sr").scalar()).alias("return_z"),
        )
        return gp.regimes(z, "vix_z", "return_z", "z")

    return once(spark, sf_dir, "regimes", build)


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "exits", lambda: ps.detect_exits(classified(spark, sf_dir)))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        t = gp.temporal_nodes(panel(spark, sf_dir), regimes(spark, sf_dir), ["pct_nav", "pe", "rsi"])
        return t.unionByName(gp.causal_nodes(links(spark, sf_dir), parents(spark, sf_dir), effects(spark, sf_dir)))

    return once(spark, sf_dir, "graph_nodes", build, "label")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        t = gp.temporal_edges(panel(spark, sf_dir), exits(spark, sf_dir), regimes(spark, sf_dir))
        c = gp.causal_edges(links(spark, sf_dir), parents(spark, sf_dir), effects(spark, sf_dir))
        return t.unionByName(c).unionByName(gp.bridge_edges(links(spark, sf_dir), panel(spark, sf_dir)))

    return once(spark, sf_dir, "graph_edges", build, "etype")


def subgraphs(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Edge list and shape key of every decision; with ``only`` (fund, period) of those funds and months."""
    d = eg.top_drivers(links(spark, sf_dir), eg.TOP_DRIVERS)
    p = eg.top_parents(parents(spark, sf_dir))
    h = panel(spark, sf_dir).select("fund", "isin", "period", "sector", "pct_nav")
    if only is not None:
        h = h.join(F.broadcast(only), ["fund", "period"], "left_semi")
    return eg.shape_key(eg.decision_subgraphs(h, regimes(spark, sf_dir), d, p))


def path_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What decision paths are built from: panel, regimes, drivers and the parents that are sure."""
    d = eg.top_drivers(links(spark, sf_dir), eg.PATH_DRIVERS)
    return panel(spark, sf_dir), regimes(spark, sf_dir), d, parents(spark, sf_dir).where(F.col("confidence") >= 0.25)


def decision_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.decision_paths(*path_parts(spark, sf_dir))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape key of every decision's subgraph."""
    return once(spark, sf_dir, "shapes", lambda: subgraphs(spark, sf_dir).select("fund", "isin", "period", "shape"))


def shape_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtree histograms of the distinct shapes.

    One decision stands for each shape, so edge lists are only built for as
    many funds and months as there are shapes.
    """

    def build():
        first = staged(eg.representatives(shapes(spark, sf_dir)), "shape_firsts", sf_dir)
        g = subgraphs(spark, sf_dir, first.select("fund", "period").distinct())
        one = g.join(F.broadcast(first.drop("shape")), ["fund", "isin", "period"], "left_semi").groupBy("shape").agg(F.min("edges").alias("edges"))
        return eg.wl_histograms(staged(one, "shape_edges", sf_dir), "shape")

    return once(spark, sf_dir, "shape_histograms", build)


def shape_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "shape_similarity", lambda: eg.shape_similarity(shape_histograms(spark, sf_dir)))
