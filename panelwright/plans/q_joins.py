"""Queries over id maps, fills, fuzzy names, the assembled panel and coverage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import joins as jn
from panelwright.operators import reports as rp
from panelwright.plans import views as v
from panelwright.plans.registry import query, round_sql, rounded
from panelwright.plans.sqlviews import sql


@query("id_map_outer", sql("""
    SELECT coalesce(a.isin, b.isin) AS isin, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.stock_name, b.stock_name) AS stock_name
    FROM id_map_a a FULL OUTER JOIN id_map_b b ON a.isin = b.isin""", "id_map_a", "id_map_b"))
def id_map_outer(spark, sf):
    """Two id maps merged, first map preferred (JN1)."""
    return jn.merge_id_maps(v.id_map_a(spark, sf), v.id_map_b(spark, sf), "isin", ["symbol", "stock_name"])


@query("first_source_lookup", sql("""
    WITH m AS (SELECT isin, upper(trim(symbol)) AS symbol, 0 AS s FROM id_map_a WHERE symbol IS NOT NULL
               UNION ALL SELECT isin, upper(trim(symbol)), 1 FROM id_map_b),
    l AS (SELECT isin, arg_min(symbol, s) AS symbol FROM m GROUP BY isin)
    SELECT h.isin, symbol, count(*) AS n FROM holdings h LEFT JOIN l USING (isin) GROUP BY ALL""", "holdings", "id_map_a", "id_map_b"))
def first_source_lookup(spark, sf):
    """Lookup where the earlier source wins; its size at run time decides how it is joined (JN3)."""
    look = jn.first_source_wins([v.id_map_a(spark, sf), v.id_map_b(spark, sf)], "isin", "symbol")
    h = v.holdings(spark, sf).select("isin")
    return h.join(look, "isin", "left").groupBy("isin", "symbol").agg(F.count("*").alias("n"))


@query("id_coverage", sql("""
    SELECT count(*) AS n_ids, count(a.isin) AS n_matched, count(*) - count(a.isin) AS n_missing
    FROM (SELECT DISTINCT isin FROM holdings) h LEFT JOIN id_map_a a USING (isin)""", "holdings", "id_map_a"))
def id_coverage(spark, sf):
    """Matched and missing ids (JN4)."""
    return jn.coverage_counts(v.holdings(spark, sf), v.id_map_a(spark, sf), "isin")


@query("fundamentals_left_join", sql("""
    SELECT h.fund, h.isin, h.period, f.pe, f.pb, f.market_cap, f.month_ord AS fund_month_ord
    FROM holdings h LEFT JOIN fundamentals f ON f.isin = h.isin AND f.period = h.period""", "holdings", "fundamentals"))
def fundamentals_left_join(spark, sf):
    """Left join on stock and month against a right side made unique; clashing names get a prefix (JN2, PRJ16)."""
    f = v.fundamentals(spark, sf)
    doubled = f.unionByName(f.withColumn("pe", F.col("pe") + 1))
    h = v.holdings(spark, sf).select("fund", "isin", "period", "month_ord")
    j = jn.left_join_unique(h, doubled, ["isin", "period"], "fund", [F.col("pe").asc()])
    return j.select("fund", "isin", "period", "pe", "pb", "market_cap", "fund_month_ord")


@query("fill_missing_fundamentals", sql("""
    WITH q AS (SELECT isin, CAST(substr(period, 1, 4) AS INT) AS y, round(avg(pe), 9) AS pe FROM fundamentals GROUP BY ALL)
    SELECT h.fund, h.isin, h.period, coalesce(f.pe, q.pe) AS pe FROM holdings h
    LEFT JOIN fundamentals f ON f.isin = h.isin AND f.period = h.period
    LEFT JOIN q ON q.isin = h.isin AND q.y = CAST(substr(h.period, 1, 4) AS INT)""", "holdings", "fundamentals"))
def fill_missing_fundamentals(spark, sf):
    """Only rows still missing are filled, from a second source (JN6)."""
    f = v.fundamentals(spark, sf).select("isin", "period", "pe")
    yearly = f.groupBy("isin", F.substring("period", 1, 4).alias("year")).agg(F.round(F.avg("pe"), 9).alias("pe"))
    h = v.holdings(spark, sf).select("fund", "isin", "period", F.substring("period", 1, 4).alias("year"))
    return jn.fill_missing(h.join(f, ["isin", "period"], "left"), yearly, ["isin", "year"], ["pe"]).drop("year")


_NAMES = """
  t AS (SELECT substr(md5(c_name), 1, 12) AS target FROM customer),
  n AS (SELECT CASE CAST(substr(c_name, 10) AS INT) % 4
      WHEN 0 THEN substr(md5(c_name), 1, 4) || 'z' || substr(md5(c_name), 5, 8)
      WHEN 1 THEN 'y' || substr(md5(c_name), 2, 8) || 'x' || substr(md5(c_name), 11, 2)
      WHEN 2 THEN substr(md5(c_name), 3, 10) ELSE reverse(substr(md5(c_name), 1, 12)) END AS name FROM customer)"""


def _names(spark, sf):
    c = v.table(spark, sf, "customer")
    h = F.md5(F.col("c_name"))
    kind = F.substring("c_name", 10, 9).cast("int") % 4
    dirty = (
        F.when(kind == 0, F.concat(F.substring(h, 1, 4), F.lit("z"), F.substring(h, 5, 8)))
        .when(kind == 1, F.concat(F.lit("y"), F.substring(h, 2, 8), F.lit("x"), F.substring(h, 11, 2)))
        .when(kind == 2, F.substring(h, 3, 10))
        .otherwise(F.reverse(F.substring(h, 1, 12)))
    )
    return c.select(dirty.alias("name")), c.select(F.substring(h, 1, 12).alias("name"))


@query("fuzzy_names", f"""
    WITH {_NAMES},
    p AS (SELECT DISTINCT name, target, 1.0::DOUBLE - levenshtein(name, target) / greatest(length(name), length(target))::DOUBLE AS similarity FROM n, t)
    SELECT name, max(target) AS target, round(max(similarity) + 1.7e-9, 6) AS similarity FROM (
      SELECT *, max(similarity) OVER (PARTITION BY name) AS best FROM p WHERE similarity >= 0.75) WHERE similarity = best GROUP BY name""")
def fuzzy_names(spark, sf):
    """Best company name by edit similarity of at least 0.75 (JN5)."""
    names, targets = _names(spark, sf)
    return rounded(jn.fuzzy_match(names, targets), 6)


@query("fuzzy_names_ratio")
def fuzzy_names_ratio(spark, sf):
    """Same with the block-matching ratio on the candidate pairs (JN5)."""
    names, targets = _names(spark, sf)
    return rounded(jn.fuzzy_match(names, targets, by_ratio=True), 9)


_PANEL = "rsi macd_hist bollinger_pband monthly_return monthly_volatility volume_ratio sentiment_mean"


@query("assembled_panel", sql(f"""
    SELECT fund, isin, period, position_action, consensus_count, news_count, pe, pb, market_cap, index_close, index_return, vix, repo_rate, cpi,
      {round_sql(_PANEL, 4)} FROM panel""", "panel"))
def assembled_panel(spark, sf):
    """Decisions with indicators, sentiment, fundamentals and macro; row count kept (JN7, JN8)."""
    p = v.panel(spark, sf).select(
        "fund", "isin", "period", "position_action", "consensus_count", "news_count", "pe", "pb", "market_cap",
        "index_close", "index_return", "vix", "repo_rate", "cpi", *_PANEL.split(),
    )
    return p.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in _PANEL.split()})


@query("join_match_report", sql("""
    SELECT count(*) AS n, count(rsi) AS technical, count(sentiment_mean) AS sentiment, count(pe) AS fundamental, count(index_close) AS macro,
      (SELECT count(*) FROM holdings) AS base_rows FROM panel""", "panel"))
def join_match_report(spark, sf):
    """Matches per source and the row-count invariant (JN7)."""
    return v.panel(spark, sf).agg(
        F.count("*").alias("n"), F.count("rsi").alias("technical"), F.count("sentiment_mean").alias("sentiment"),
        F.count("pe").alias("fundamental"), F.count("index_close").alias("macro"),
    ).withColumn("base_rows", v.holdings(spark, sf).agg(F.count("*")).scalar())


_COV = ["rsi", "bollinger_pband", "sentiment_mean", "news_count", "pe", "pb", "index_return", "pct_nav", "vix", "empty_col"]


@query("coverage_report", sql(f"""
    SELECT column_name, round(pct, 6) AS pct, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' WHEN pct > 0 THEN 'low' ELSE 'empty' END AS band
    FROM (SELECT {', '.join(f"100.0::DOUBLE * count({c}) / count(*) AS {c}" for c in _COV)} FROM (SELECT *, NULL::DOUBLE AS empty_col FROM panel))
    UNPIVOT (pct FOR column_name IN ({', '.join(_COV)}))""", "panel"))
def coverage_report(spark, sf):
    """Percent of known values per column and its band (AG16)."""
    return rounded(rp.coverage(v.panel(spark, sf).withColumn("empty_col", F.lit(None).cast("double")), _COV))


@query("group_mean_enrichment", sql("""
    SELECT c.fund, c.isin, c.period, round(rsi, 4) AS rsi, round(pe, 6) AS pe FROM classified c
    LEFT JOIN (SELECT isin, period, avg(rsi) AS rsi, avg(pe) AS pe FROM panel GROUP BY ALL) USING (isin, period)""", "panel"))
def group_mean_enrichment(spark, sf):
    """Group means of new columns joined to the panel (JN10)."""
    c = v.classified(spark, sf).select("fund", "isin", "period", "pct_nav")
    j = jn.group_mean_features(c, v.panel(spark, sf), ["isin", "period"], ["pct_nav", "rsi", "pe"])
    return j.select("fund", "isin", "period", F.round("rsi", 4).alias("rsi"), F.round("pe", 6).alias("pe"))
