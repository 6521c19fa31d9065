"""Queries over bars, indicators, news sentiment and macro series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import macro_tables as mt
from panelwright.functions import periods as pr
from panelwright.operators import bars as br
from panelwright.operators import macro as ma
from panelwright.operators import sentiment as st
from panelwright.plans import views as v
from panelwright.plans.registry import near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import sql


@query("monthly_bars", sql("""
    SELECT *, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY period) - 1, 6) + 0.0::DOUBLE AS period_return FROM (
      SELECT symbol, period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume
      FROM bars GROUP BY symbol, period)""", "bars"))
def monthly_bars(spark, sf):
    """Daily bars to months and the close-to-close return (AG1, WN16)."""
    m = br.coarsen(v.bars(spark, sf), ["symbol", "period"], "date")
    w = W.partitionBy("symbol").orderBy("period")
    return m.withColumn("period_return", F.round(br.pct_change(F.col("close"), w), 6) + F.lit(0.0))


@query("daily_bars", sql("SELECT symbol, CAST(date AS VARCHAR) AS date, open, high, low, close, volume FROM bars", "bars"))
def daily_bars(spark, sf):
    """Trades to daily bars (AG1 first step)."""
    return v.bars(spark, sf).select("symbol", F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "volume")


@query("moving_averages", sql("""
    SELECT symbol, CAST(date AS VARCHAR) AS date, round(sma50, 4) AS sma50, round(sma200, 4) AS sma200, golden_cross, death_cross FROM indicators""", "indicators"))
def moving_averages(spark, sf):
    """Full-window averages and their crosses (WN9, WN13)."""
    d = br.window_indicators(v.bars(spark, sf))
    return rounded(d.select("symbol", F.col("date").cast("string").alias("date"), "sma50", "sma200", "golden_cross", "death_cross"), 4)


@query("bollinger_atr_obv", sql("""
    SELECT symbol, CAST(date AS VARCHAR) AS date, round(bollinger_pband, 5) + 0.0::DOUBLE AS bollinger_pband, round(atr, 4) AS atr, obv,
      round(daily_return, 6) + 0.0::DOUBLE AS daily_return FROM indicators""", "indicators"))
def bollinger_atr_obv(spark, sf):
    """Bollinger %B, average true range, on-balance volume, daily return (WN10, WN11, WN12, WN16)."""
    d = br.window_indicators(v.bars(spark, sf))
    return d.select(
        "symbol", F.col("date").cast("string").alias("date"),
        (F.round("bollinger_pband", 5) + F.lit(0.0)).alias("bollinger_pband"), F.round("atr", 4).alias("atr"), "obv",
        (F.round("daily_return", 6) + F.lit(0.0)).alias("daily_return"),
    )


@query("macd_rsi", sql(f"""
    SELECT symbol, CAST(date AS VARCHAR) AS date, {round_sql('macd_line macd_signal macd_hist rsi', 5)} FROM recursive_1""", "recursive_1"))
def macd_rsi(spark, sf):
    """Recursive averages: MACD and Wilder RSI (WN14, WN15)."""
    d = br.recursive_indicators(v.bars(spark, sf))
    return rounded(d.withColumn("date", F.col("date").cast("string")), 5)


_MONTHLY = "rsi macd_line macd_signal macd_hist bollinger_pband sma50 sma200 obv atr monthly_return monthly_volatility volume_ratio"


@query("monthly_indicators", sql(f"SELECT symbol, period, golden_cross, death_cross, {round_sql(_MONTHLY, 4)} FROM monthly_indicators", "monthly_indicators"))
def monthly_indicators(spark, sf):
    """Daily indicators to months: last levels, any cross, means and dispersion (AG2)."""
    return rounded(br.monthly_rollup(v.daily_indicators(spark, sf)), 4)


@query("score_fields", sql(f"SELECT event_id, label, {round_sql('compound confidence', 9)} FROM scored_news", "scored_news"))
def score_fields(spark, sf):
    """Compound, confidence and label from class probabilities (ML19 arithmetic)."""
    return rounded(v.scored_news(spark, sf).select("event_id", "label", "compound", "confidence"), 9)


_SENT = """sentiment_mean sentiment_mean_raw sentiment_std sentiment_median sentiment_confidence sentiment_skew sentiment_extremity
  sentiment_dispersion avg_positive_prob avg_negative_prob avg_neutral_prob max_sentiment min_sentiment pct_strongly_positive
  pct_strongly_negative positive_ratio negative_ratio""".split()


@query("period_sentiment", sql(f"SELECT isin, period, news_count, {round_sql(_SENT)} FROM sentiment_1", "sentiment_1"))
def period_sentiment(spark, sf):
    """Moments, shares, weighted mean, median, extremity and dispersion (AG5, AG6, AG7, AG8, WN23)."""
    return rounded(st.period_sentiment(v.scored_news(spark, sf), ["isin", "period"], "hour"))


@query("sentiment_dynamics", sql(f"""
    SELECT isin, period, news_count, {round_sql('sentiment_mean sentiment_std sentiment_momentum sentiment_reversal')} FROM sentiment""", "sentiment"))
def sentiment_dynamics(spark, sf):
    """Momentum and reversal with thin periods set to missing (WN21, WN22, AG8)."""
    return rounded(
        v.sentiment(spark, sf).select("isin", "period", "news_count", "sentiment_mean", "sentiment_std", "sentiment_momentum", "sentiment_reversal")
    )


POSITIVE = ["the", "and", "for", "with", "on"]
NEGATIVE = ["that", "not", "is", "in", "of"]


@query("lexicon_scores", f"""
    WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(trim(text)), '[^a-z]+'), lambda t: t <> '') AS t FROM documents),
    c AS (SELECT doc_id, lang, len(t)::DOUBLE AS n, len(list_filter(t, lambda x: x IN ({', '.join(repr(x) for x in POSITIVE)})))::DOUBLE AS p,
            len(list_filter(t, lambda x: x IN ({', '.join(repr(x) for x in NEGATIVE)})))::DOUBLE AS g FROM w),
    s AS (SELECT doc_id, lang, CASE WHEN n = 0 THEN 0 ELSE p / n END AS pp, CASE WHEN n = 0 THEN 0 ELSE g / n END AS np,
            CASE WHEN n = 0 THEN 1 ELSE (n - p - g) / n END AS up FROM c)
    SELECT doc_id, lang, {near_sql("pp")} AS positive_prob, {near_sql("np")} AS negative_prob, {near_sql("up")} AS neutral_prob,
      {near_sql("(pp - np) * (1 - up)")} AS compound, {near_sql("greatest(pp, np, up)")} AS confidence,
      CASE WHEN pp >= np AND pp >= up THEN 'positive' WHEN np >= up THEN 'negative' ELSE 'neutral' END AS label FROM s""")
def lexicon_scores(spark, sf):
    """Built-in word-list scorer over whole texts (ML19)."""
    d = v.headlines(spark, sf).select("doc_id", "lang", "text")
    return rounded(st.score_with_lexicon(d, "text", POSITIVE, NEGATIVE).drop("text"))


def _quoted(words):
    return "[" + ", ".join(repr(w) for w in words) + "]"


@query("polarity_scores", f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda t: t <> '') AS t FROM documents),
    h AS (SELECT doc_id, list_filter(list_transform(t, lambda x, i: CASE WHEN NOT list_contains({_quoted(st.RISING + st.FALLING)}, x) THEN 0 ELSE
        (CASE WHEN list_contains({_quoted(st.RISING)}, x) THEN 1 ELSE -1 END) * (CASE WHEN list_has_any(t[greatest(1, i - {st.NEGATION_REACH}):i - 1], {_quoted(st.NEGATORS)}) THEN -1 ELSE 1 END) END), lambda s: s <> 0) AS s FROM w),
    c AS (SELECT doc_id, len(list_filter(s, lambda x: x > 0))::DOUBLE AS p, len(list_filter(s, lambda x: x < 0))::DOUBLE AS g FROM h)
    SELECT doc_id, {near_sql("p / (p + g + 1)")} AS positive_prob, {near_sql("g / (p + g + 1)")} AS negative_prob, {near_sql("1 / (p + g + 1)")} AS neutral_prob FROM c""")
def polarity_scores(spark, sf):
    """Stated list of market words with negation over whole texts (ML19)."""
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    return rounded(st.score_with_polarity(d, "text").select("doc_id", "positive_prob", "negative_prob", "neutral_prob"))


@query("pluggable_scores", """
    WITH s AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE (length(trim(text)) % 7 + 1) / 16.0::DOUBLE END AS p,
                 CASE WHEN trim(text) = '' THEN 0 ELSE (length(trim(text)) % 5 + 1) / 16.0::DOUBLE END AS g FROM documents)
    SELECT doc_id, p AS positive_prob, g AS negative_prob, 1 - p - g AS neutral_prob FROM s""")
def pluggable_scores(spark, sf):
    """The model seam: any batch scorer in Arrow batches (ML19)."""

    def by_length(texts):
        n = texts.str.len()
        p, g = (n % 7 + 1) / 16.0, (n % 5 + 1) / 16.0
        return p, g, 1 - p - g

    d = v.headlines(spark, sf).select("doc_id", "text")
    return st.score_with(d, "text", by_length).select("doc_id", "positive_prob", "negative_prob", "neutral_prob")


@query("macro_monthly", sql("SELECT period, index_close, index_return, vix, repo_rate, cpi FROM macro", "macro"))
def macro_monthly(spark, sf):
    """Monthly market series from the orders."""
    return v.macro(spark, sf).select("period", "index_close", "index_return", "vix", "repo_rate", "cpi")


_SHIFT = 27 * 12


@query("macro_constant_tables", f"""
    WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, count(*) AS n FROM orders GROUP BY 1),
    k AS (SELECT p, n, CAST(CAST(substr(p, 1, 4) AS INT) + 27 AS VARCHAR) || substr(p, 5, 3) AS period FROM m),
    repo(period, repo_rate) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in mt.REPO_RATE.items())}),
    cpi(period, cpi_inflation) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in mt.CPI_INFLATION.items())}),
    gdp(q, gdp_growth) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in mt.GDP_GROWTH.items())})
    SELECT k.period, k.n, repo_rate, cpi_inflation, gdp_growth, round(repo_rate - cpi_inflation, 6) + 0.0::DOUBLE AS real_interest_rate
    FROM k LEFT JOIN repo USING (period) LEFT JOIN cpi USING (period)
    LEFT JOIN gdp ON q = 'Q' || CAST((CAST(substr(k.period, 6, 2) AS INT) - 1) // 3 + 1 AS VARCHAR) || '-' || substr(k.period, 1, 4)""")
def macro_constant_tables(spark, sf):
    """Literal and quarterly rate tables joined to the order calendar moved 27 years (SRC5, SRC6, JN9, PRJ19)."""
    o = v.table(spark, sf, "orders").groupBy(pr.ordinal_period(pr.month_ordinal(F.col("o_orderdate")) + _SHIFT).alias("period")).agg(F.count("*").alias("n"))
    gdp = ma.quarters_to_months(spark.createDataFrame(list(mt.GDP_GROWTH.items()), "q string, gdp_growth double"), "q", "gdp_growth")
    df = ma.join_on_spine(
        o, [ma.constant_series(spark, mt.REPO_RATE, "repo_rate"), ma.constant_series(spark, mt.CPI_INFLATION, "cpi_inflation"), gdp]
    )
    return df.withColumn("real_interest_rate", F.round(F.col("repo_rate") - F.col("cpi_inflation"), 6) + F.lit(0.0))


@query("macro_spine_fill", sql(f"""
    WITH s AS (SELECT strftime(d, '%Y-%m') AS period FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS d)),
    thin AS (SELECT period, index_close, repo_rate FROM macro WHERE month_ord % 4 <> 0),
    q AS (SELECT period, cpi, vix FROM macro WHERE month_ord % 3 = 1),
    j AS (SELECT s.period, index_close, repo_rate, cpi, vix FROM s LEFT JOIN thin USING (period) LEFT JOIN q USING (period)),
    f AS (SELECT period, last_value(index_close IGNORE NULLS) OVER w AS index_close, last_value(repo_rate IGNORE NULLS) OVER w AS repo_rate,
            last_value(cpi IGNORE NULLS) OVER w AS cpi, last_value(vix IGNORE NULLS) OVER w AS vix
          FROM j WINDOW w AS (ORDER BY period ROWS UNBOUNDED PRECEDING))
    SELECT period, index_close, repo_rate, cpi, vix, round(index_close / lag(index_close) OVER (ORDER BY period) - 1, 6) + 0.0::DOUBLE AS index_close_pct,
      round(vix / lag(vix) OVER (ORDER BY period) - 1, 6) + 0.0::DOUBLE AS vix_pct,
      repo_rate - cpi AS real_interest_rate, repo_rate - lag(repo_rate) OVER (ORDER BY period) AS repo_rate_change FROM f""", "macro"))
def macro_spine_fill(spark, sf):
    """Series on a full month spine, carried forward, with derived rates (SRC7, JN9, WN24, WN17, PRJ19)."""
    m = v.macro(spark, sf)
    spine = ma.month_spine(spark, "1994-11", "2001-12")
    thin = m.where(F.col("month_ord") % 4 != 0).select("period", "index_close", "repo_rate")
    q = m.where(F.col("month_ord") % 3 == 1).select("period", "cpi", "vix")
    j = ma.forward_fill(ma.join_on_spine(spine, [thin, q]), ["index_close", "repo_rate", "cpi", "vix"])
    d = ma.derive_macro(j)
    return d.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("index_close_pct", "vix_pct")})


@query("last_value_per_month", """
    SELECT strftime(o_orderdate, '%Y-%m') AS period, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS gold_usd
    FROM (SELECT o_orderdate, max(o_totalprice) AS o_totalprice, 0 AS o_orderkey FROM orders GROUP BY 1) GROUP BY 1""")
def last_value_per_month(spark, sf):
    """Date and price column found by name, last known value per month (SRC8)."""
    o = v.table(spark, sf, "orders")
    days = o.groupBy("o_orderdate").agg(F.max("o_totalprice").alias("spot_price"))
    return ma.last_per_month(days.withColumn("Trade_Date", F.to_date("o_orderdate")).select("Trade_Date", "spot_price"), "gold_usd")


_SYMS = ["INE001", "INE007", "INE012", "INE020"]


@query("pivot_symbols", sql(f"""
    SELECT period, {', '.join(f"max(close) FILTER (symbol = '{s}') AS {s}_close, round(max(monthly_return) FILTER (symbol = '{s}'), 6) + 0.0::DOUBLE AS {s}_return" for s in _SYMS)}
    FROM (SELECT symbol, period, arg_max(close, date) AS close, arg_max(close, date) / arg_min(close, date) - 1 AS monthly_return FROM bars
          WHERE symbol IN ({', '.join(repr(s) for s in _SYMS)}) GROUP BY ALL) GROUP BY period""", "bars"))
def pivot_symbols(spark, sf):
    """Close and return of chosen symbols as columns (AG9)."""
    m = v.bars(spark, sf).groupBy("symbol", "period").agg(
        F.max_by("close", "date").alias("close"), F.round(F.max_by("close", "date") / F.min_by("close", "date") - 1, 6).alias("ret")
    )
    p = ma.pivot_symbols(m, _SYMS, {"close": "close", "ret": "return"})
    return p.withColumns({f"{s}_return": F.col(f"{s}_return") + F.lit(0.0) for s in _SYMS})


@query("macro_panel", sql("""
    SELECT period, arg_min(index_close, (fund, isin)) AS index_close, arg_min(index_return, (fund, isin)) FILTER (index_return IS NOT NULL) AS index_return,
      arg_min(vix, (fund, isin)) FILTER (vix IS NOT NULL) AS vix, arg_min(repo_rate, (fund, isin)) FILTER (repo_rate IS NOT NULL) AS repo_rate,
      round(arg_min(monthly_return, (fund, isin)) FILTER (monthly_return IS NOT NULL), 6) + 0.0::DOUBLE AS monthly_return
    FROM panel GROUP BY period""", "panel"))
def macro_panel(spark, sf):
    """First known macro value per month over columns chosen by name (AG10)."""
    p = v.panel(spark, sf)
    cols = ma.macro_columns(p.columns, ["repo_rate"])
    out = ma.macro_panel(p.select("fund", "isin", "period", *cols), cols, ["fund", "isin"])
    return out.withColumn("monthly_return", F.round("monthly_return", 6) + F.lit(0.0))


@query("bars_long_series", sql("SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 30", "bars"))
def bars_long_series(spark, sf):
    """Symbols with at least 30 bars (FLT6)."""
    return br.drop_short_series(v.bars(spark, sf), ["symbol"], 30).groupBy("symbol").agg(F.count("*").alias("n"))
