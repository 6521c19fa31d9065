"""The same domain views as SQL text, used to build the check queries.

``sql(body, ...)`` prefixes a query with the views it names. Each entry lists
the views it needs; the text is written on its own, not generated from the
DataFrame code it checks.
"""

from __future__ import annotations

SECTOR_SQL = (
    "CASE CAST(substr({0}, 4, 3) AS INT) % 6 WHEN 0 THEN 'FINANCIAL SERVICES' WHEN 1 THEN 'INFORMATION TECHNOLOGY' "
    "WHEN 2 THEN 'HEALTHCARE' WHEN 3 THEN 'ENERGY' WHEN 4 THEN 'AUTOMOBILE' ELSE 'FMCG' END"
)

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], text: str) -> None:
    VIEWS[name] = (needs, text)


def sql(body: str, *names: str) -> str:
    """``body`` with a WITH clause for ``names`` and everything they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in VIEWS[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in done)
    if not done:
        return body
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + ",\n" + (rest[9:] if recursive else rest)
    return "WITH " + ctes + "\n" + body


view("lines", [], """
  SELECT l.*, 'INE' || lpad(replace(p.p_brand, 'Brand#', ''), 3, '0') AS isin, p.p_retailprice,
         strftime(l.l_shipdate, '%Y-%m') AS period,
         CAST(year(l.l_shipdate) * 12 + month(l.l_shipdate) AS INT) AS month_ord
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")

view("holdings", ["lines"], f"""
  SELECT s.s_name AS fund, a.isin, a.period, a.month_ord, a.quantity, a.market_value,
         round(100.0 * a.market_value / round(sum(a.market_value) OVER (PARTITION BY a.l_suppkey, a.period), 2), 6) AS pct_nav,
         {SECTOR_SQL.format('a.isin')} AS sector,
         CASE s.s_nationkey % 3 WHEN 0 THEN 'small cap' WHEN 1 THEN 'mid cap' ELSE 'large cap' END AS fund_type
  FROM (SELECT l_suppkey, isin, period, month_ord, sum(l_quantity) AS quantity,
               round(sum(l_extendedprice), 2) AS market_value
        FROM lines GROUP BY ALL) a JOIN supplier s ON a.l_suppkey = s.s_suppkey""")

view("classified_0", ["holdings"], """
  SELECT *, lag(month_ord) OVER w AS p_ord, lag(pct_nav) OVER w AS p_nav, lag(quantity) OVER w AS p_qty
  FROM holdings WINDOW w AS (PARTITION BY fund, isin ORDER BY month_ord)""")
view("classified_1", ["classified_0"], """
  SELECT *, CASE WHEN p_ord IS NULL OR month_ord - p_ord > 3 THEN 'INITIAL_POSITION'
              WHEN p_qty > 0 AND quantity > p_qty AND (quantity - p_qty) / p_qty > 0.005 THEN 'BUY'
              WHEN p_qty > 0 AND quantity < p_qty AND (p_qty - quantity) / p_qty > 0.005 THEN 'SELL'
              WHEN pct_nav - p_nav > 0.1 THEN 'BUY' WHEN pct_nav - p_nav < -0.1 THEN 'SELL' ELSE 'HOLD' END AS position_action
  FROM classified_0""")
view("classified_2", ["classified_1"], """
  SELECT *, sum(CASE WHEN position_action = 'INITIAL_POSITION' THEN 1 ELSE 0 END)
              OVER (PARTITION BY fund, isin ORDER BY month_ord) AS period_no
  FROM classified_1""")
view("classified", ["classified_2"], """
  SELECT fund, isin, period, month_ord, quantity, market_value, pct_nav, sector, fund_type,
         month_ord - p_ord AS month_gap, quantity - p_qty AS quantity_change,
         CASE WHEN position_action = 'INITIAL_POSITION' THEN pct_nav ELSE pct_nav - p_nav END AS allocation_change,
         position_action,
         CASE WHEN position_action = 'INITIAL_POSITION' THEN pct_nav ELSE abs(pct_nav - p_nav) END AS size,
         fund || '|' || isin || '|' || CAST(period_no AS VARCHAR) AS holding_period_id,
         CAST(row_number() OVER (PARTITION BY fund, isin, period_no ORDER BY month_ord) AS INT) AS holding_tenure
  FROM classified_2""")

view("bars", ["lines"], """
  SELECT isin AS symbol, CAST(l_shipdate AS DATE) AS date, period, month_ord,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
         sum(l_quantity) AS volume
  FROM lines GROUP BY ALL""")

view("indicators_1", ["bars"], """
  SELECT *, lag(close) OVER w AS p_close,
    CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma20,
    CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS sd20,
    CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma50,
    CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS sma200
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date),
    w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    w50 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
    w200 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")
view("indicators_2", ["indicators_1"], """
  SELECT *, greatest(high - low, coalesce(abs(high - p_close), high - low), coalesce(abs(low - p_close), high - low)) AS tr,
    volume * coalesce(sign(close - p_close), 0) AS flow,
    lag(sma50) OVER w AS p50, lag(sma200) OVER w AS p200, close / p_close - 1 AS daily_return,
    (close - (sma20 - 2 * sd20)) / nullif(4 * sd20, 0) AS bollinger_pband
  FROM indicators_1 WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
view("indicators", ["indicators_2"], """
  SELECT symbol, date, period, month_ord, close, volume, sma50, sma200, bollinger_pband, daily_return,
    CASE WHEN sma50 > sma200 AND p50 <= p200 THEN 1 ELSE 0 END AS golden_cross,
    CASE WHEN sma50 < sma200 AND p50 >= p200 THEN 1 ELSE 0 END AS death_cross,
    CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr,
    sum(flow) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv
  FROM indicators_2
  WINDOW w14 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")

view("series", ["bars"], """
  SELECT symbol, list(date ORDER BY date) AS ds, list(close ORDER BY date) AS cs FROM bars GROUP BY symbol""")
view("recursive_1", ["bars"], """
  WITH RECURSIVE n AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars),
  r AS (
    SELECT symbol, date, i, close, close AS f, close AS s, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn
    FROM n WHERE i = 1
    UNION ALL
    SELECT n.symbol, n.date, n.i, n.close,
      n.close * (2.0 / 13.0) + r.f * (1.0 - 2.0 / 13.0),
      n.close * (2.0 / 27.0) + r.s * (1.0 - 2.0 / 27.0),
      ((n.close * (2.0 / 13.0) + r.f * (1.0 - 2.0 / 13.0)) - (n.close * (2.0 / 27.0) + r.s * (1.0 - 2.0 / 27.0))) * 0.2 + r.g * 0.8,
      CASE WHEN n.i - 1 < 14 THEN r.up + greatest(n.close - r.close, 0)
           WHEN n.i - 1 = 14 THEN (r.up + greatest(n.close - r.close, 0)) / 14
           ELSE (r.up * 13 + greatest(n.close - r.close, 0)) / 14 END,
      CASE WHEN n.i - 1 < 14 THEN r.dn + greatest(r.close - n.close, 0)
           WHEN n.i - 1 = 14 THEN (r.dn + greatest(r.close - n.close, 0)) / 14
           ELSE (r.dn * 13 + greatest(r.close - n.close, 0)) / 14 END
    FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
  SELECT symbol, date, i, f - s AS macd_line, g AS macd_signal, f - s - g AS macd_hist,
         CASE WHEN i > 14 AND dn <> 0 THEN 100.0 - 100.0 / (1.0 + up / dn) END AS rsi
  FROM r""")

view("monthly_indicators", ["indicators", "recursive_1"], """
  SELECT d.symbol, d.period,
    arg_max(rsi, d.date) FILTER (rsi IS NOT NULL) AS rsi, arg_max(macd_line, d.date) AS macd_line,
    arg_max(macd_signal, d.date) AS macd_signal, arg_max(macd_hist, d.date) AS macd_hist,
    arg_max(bollinger_pband, d.date) FILTER (bollinger_pband IS NOT NULL) AS bollinger_pband,
    arg_max(sma50, d.date) FILTER (sma50 IS NOT NULL) AS sma50,
    arg_max(sma200, d.date) FILTER (sma200 IS NOT NULL) AS sma200,
    arg_max(obv, d.date) AS obv, max(golden_cross) AS golden_cross, max(death_cross) AS death_cross,
    avg(atr) AS atr, arg_max(close, d.date) / arg_min(close, d.date) - 1 AS monthly_return,
    stddev_samp(daily_return) AS monthly_volatility, avg(volume / m.mean_vol) AS volume_ratio
  FROM indicators d JOIN recursive_1 r USING (symbol, date)
  JOIN (SELECT symbol, avg(volume) AS mean_vol FROM indicators GROUP BY symbol) m ON m.symbol = d.symbol
  GROUP BY d.symbol, d.period""")

view("scored_news_0", [], """
  SELECT event_id, 'INE' || lpad(CAST(user_id % 25 + 1 AS VARCHAR), 3, '0') AS isin, ts, event_type,
         CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour,
         1995 * 12 + 1 + 2 * (day(ts) - 1) AS ord,
         CAST(CASE event_type WHEN 'purchase' THEN 6 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS DOUBLE) AS a,
         CAST(CAST(round(value * 100) AS BIGINT) % 5 + 1 AS DOUBLE) AS b, CAST(event_id % 4 AS DOUBLE) AS c
  FROM events""")
view("scored_news", ["scored_news_0"], """
  SELECT event_id, isin, ts, event_type, day, hour,
         CAST((ord - 1) // 12 AS VARCHAR) || '-' || lpad(CAST((ord - 1) % 12 + 1 AS VARCHAR), 2, '0') AS period,
         a / (a + b + c) AS positive_prob, b / (a + b + c) AS negative_prob, c / (a + b + c) AS neutral_prob,
         (a / (a + b + c) - b / (a + b + c)) * (1 - c / (a + b + c)) AS compound,
         greatest(a, b, c) / (a + b + c) AS confidence,
         CASE WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'negative' ELSE 'neutral' END AS label
  FROM scored_news_0""")
view("sentiment_0", ["scored_news"], """
  SELECT *, confidence * exp(-0.03 * (max(hour) OVER (PARTITION BY isin, period) - hour)) AS w FROM scored_news""")
view("sentiment_1", ["sentiment_0"], """
  SELECT isin, period, avg(compound) AS sentiment_mean_raw, coalesce(stddev_samp(compound), 0) AS sentiment_std,
    count(compound) AS news_count, avg(positive_prob) AS avg_positive_prob, avg(negative_prob) AS avg_negative_prob,
    avg(neutral_prob) AS avg_neutral_prob, avg(confidence) AS sentiment_confidence,
    max(compound) AS max_sentiment, min(compound) AS min_sentiment,
    CASE WHEN count(*) < 3 THEN 0 ELSE skewness(compound) END AS sentiment_skew,
    avg(CAST(positive_prob > 0.6 AS INT)) AS pct_strongly_positive, avg(CAST(negative_prob > 0.6 AS INT)) AS pct_strongly_negative,
    avg(CAST(positive_prob > 0.5 AS INT)) AS positive_ratio, avg(CAST(negative_prob > 0.5 AS INT)) AS negative_ratio,
    CASE WHEN sum(w) > 0 THEN sum(w * compound) / sum(w) ELSE avg(compound) END AS sentiment_mean,
    quantile_cont(compound, 0.5) AS sentiment_median,
    (abs(max(compound)) + abs(min(compound))) / 2 AS sentiment_extremity,
    max(compound) - min(compound) AS sentiment_dispersion
  FROM sentiment_0 GROUP BY isin, period""")
view("sentiment_2", ["sentiment_1"], """
  SELECT *, avg(sentiment_mean) OVER (PARTITION BY isin ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
    lag(sentiment_mean) OVER (PARTITION BY isin ORDER BY period) AS before
  FROM sentiment_1""")
view("sentiment_3", ["sentiment_2"], """
  SELECT * EXCLUDE (m3, before), coalesce(m3 - lag(m3) OVER (PARTITION BY isin ORDER BY period), 0) AS sentiment_momentum,
    CASE WHEN before IS NULL OR sign(sentiment_mean) <> sign(before) THEN 1.0 ELSE 0.0 END AS sentiment_reversal
  FROM sentiment_2""")
_FEW = ["sentiment_mean", "sentiment_mean_raw", "sentiment_std", "sentiment_median", "sentiment_confidence",
        "sentiment_extremity", "sentiment_dispersion", "sentiment_momentum", "sentiment_reversal", "sentiment_skew"]
view("sentiment", ["sentiment_3"], "SELECT * REPLACE ("
     + ", ".join(f"CASE WHEN news_count >= 3 THEN {c} END AS {c}" for c in _FEW) + ") FROM sentiment_3")

view("headlines", [], """
  SELECT doc_id, 'INE' || lpad(CAST(doc_id % 25 + 1 AS VARCHAR), 3, '0') AS isin, text, lang, source FROM documents""")

view("macro_0", [], """
  SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_ord,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS index_close,
    round(100 * stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS vix
  FROM orders GROUP BY ALL""")
view("macro", ["macro_0"], """
  SELECT *, round(index_close / lag(index_close) OVER (ORDER BY month_ord) - 1, 8) AS index_return,
    4.0::DOUBLE + 0.25::DOUBLE * (month_ord % 7) AS repo_rate, 5.0::DOUBLE + 0.5::DOUBLE * (month_ord % 5) AS cpi
  FROM macro_0""")

view("fundamentals", ["lines"], """
  SELECT isin, period, month_ord, round(avg(p_retailprice) / avg(l_quantity), 6) AS pe,
    round(avg(l_discount + l_tax) * 10, 8) AS pb, round(sum(l_extendedprice), 2) AS market_cap,
    round(avg(l_tax) * 100, 6) AS eps
  FROM lines GROUP BY isin, period, month_ord
  HAVING (CAST(substr(isin, 4, 3) AS INT) + month_ord) % 7 <> 0""")

view("panel", ["classified", "monthly_indicators", "sentiment", "fundamentals", "macro"], """
  SELECT c.fund, c.isin, c.period, c.month_ord, c.sector, c.fund_type, c.quantity, c.market_value, c.pct_nav,
    c.position_action, c.allocation_change, c.holding_tenure, k.consensus_count,
    t.rsi, t.macd_hist, t.bollinger_pband, t.monthly_return, t.monthly_volatility, t.volume_ratio,
    s.sentiment_mean, s.news_count, f.pe, f.pb, f.market_cap, f.eps,
    m.index_close, m.index_return, m.vix, m.repo_rate, m.cpi
  FROM classified c
  LEFT JOIN (SELECT isin, period, count(*) AS consensus_count FROM classified GROUP BY isin, period) k USING (isin, period)
  LEFT JOIN monthly_indicators t ON t.symbol = c.isin AND t.period = c.period
  LEFT JOIN sentiment s ON s.isin = c.isin AND s.period = c.period
  LEFT JOIN fundamentals f ON f.isin = c.isin AND f.period = c.period
  LEFT JOIN macro m ON m.period = c.period""")

view("brands", [], "SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS n FROM part GROUP BY 1")
view("id_map_a", ["brands"], """
  SELECT 'INE' || lpad(CAST(n AS VARCHAR), 3, '0') AS isin, CASE WHEN n % 5 <> 0 THEN 'SYM' || n END AS symbol,
    CASE WHEN n % 4 <> 0 THEN 'Company ' || n END AS stock_name FROM brands WHERE n <= 17""")
view("id_map_b", ["brands"], """
  SELECT 'INE' || lpad(CAST(n AS VARCHAR), 3, '0') AS isin, ' nse' || n AS symbol, 'Co. ' || n AS stock_name
  FROM brands WHERE n >= 9""")

STOCK_VARS = ["monthly_return", "rsi", "bollinger_pband", "macd_hist", "volume_ratio", "monthly_volatility"]
FUND_VARS = ["holding_tenure", "consensus_count", "pct_nav"]
MACRO_VARS = ["index_return", "vix", "cpi"]
CAUSES = [*STOCK_VARS, *FUND_VARS, "sentiment_mean", *MACRO_VARS]
LAGS = [0, 1, 2, 3, 4, 5, 6]
TARGETS = ["action_ordinal", "buy_ratio", "sell_ratio"]

view("pooled_0", ["panel"], """
  SELECT isin, period, avg(CASE position_action WHEN 'SELL' THEN -1 WHEN 'HOLD' THEN 0 ELSE 1 END) AS action_ordinal,
    avg(CASE WHEN position_action IN ('BUY', 'INITIAL_POSITION') THEN 1 ELSE 0 END) AS buy_ratio,
    avg(CASE WHEN position_action = 'SELL' THEN 1 ELSE 0 END) AS sell_ratio, count(*) AS n_funds,
    CASE WHEN coalesce(max(news_count), 99) >= 10 THEN max(sentiment_mean) END AS sentiment_mean, """
     + ", ".join(f"max({c}) AS {c}" for c in STOCK_VARS + MACRO_VARS) + ", "
     + ", ".join(f"avg({c}) AS {c}" for c in FUND_VARS) + " FROM panel GROUP BY isin, period")
view("pooled_m", ["pooled_0"], "SELECT period, max(index_return) AS m, max(vix) AS v, max(cpi) AS c FROM pooled_0 GROUP BY period")
view("pooled", ["pooled_0", "pooled_m"], """
  SELECT p.*, CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime_bull,
    CASE WHEN v > (SELECT median(v) FROM pooled_m) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime_hvix,
    CASE WHEN c > (SELECT median(c) FROM pooled_m) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS regime_hcpi
  FROM pooled_0 p JOIN pooled_m USING (period)""")

_LAGGED = ", ".join(f'lag({c}, {k}) OVER w AS "{c}:{k}"' if k else f'{c}::DOUBLE AS "{c}:{k}"' for c in CAUSES for k in LAGS)
_NAMES = ", ".join(f'"{c}:{k}"' for c in CAUSES for k in LAGS)
view("lagged", ["pooled"], f"SELECT isin, period, action_ordinal, buy_ratio, sell_ratio, {_LAGGED} FROM pooled WINDOW w AS (PARTITION BY isin ORDER BY period)")
view("lag_rows", ["lagged"], f"""
  SELECT isin, period, split_part(nm, ':', 1) AS cause, CAST(split_part(nm, ':', 2) AS INT) AS lag, x, action_ordinal, buy_ratio, sell_ratio
  FROM lagged UNPIVOT (x FOR nm IN ({_NAMES}))""")
view("link_rows", ["lag_rows"], " UNION ALL ".join(f"SELECT isin, cause, lag, '{t}' AS target, x, {t} AS y FROM lag_rows WHERE {t} IS NOT NULL" for t in TARGETS))
view("link_d", ["link_rows"], """
  SELECT target, cause, lag, isin, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y FROM link_rows
  WINDOW g AS (PARTITION BY target, cause, lag, isin)""")
view("link_b", ["link_d"], """
  SELECT target, cause, lag, count(*) AS n_obs, count(DISTINCT isin) AS g, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx,
    sum(x * y) AS sxy, sum(y * y) AS syy
  FROM link_d GROUP BY ALL HAVING count(*) >= 100 AND sum(x * x) > 1e-9""")
view("link_t", ["link_d", "link_b"], """
  SELECT b.target, b.cause, b.lag, b.n_obs, b.g, b.beta, b.syy, b.sxy,
    b.beta / sqrt(b.n_obs / (b.n_obs - 1.0) * s.meat / (b.sxx * b.sxx)) AS t_stat, 1 - (b.syy - b.beta * b.sxy) / b.syy AS rsquared
  FROM link_b b JOIN (SELECT target, cause, lag, sum(s * s) AS meat FROM (
      SELECT d.target, d.cause, d.lag, d.isin, sum(d.x * (d.y - b.beta * d.x)) AS s FROM link_d d JOIN link_b b USING (target, cause, lag) GROUP BY ALL)
    GROUP BY ALL) s USING (target, cause, lag)""")
# Two-sided t tail: Simpson's rule on the angle form of the density.
view("link_p", ["link_t"], """
  SELECT *, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (h / 3) * list_sum(list_transform(range(0, 2001),
      lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * h), df - 1)))) AS p_value
  FROM (SELECT *, atan(abs(t_stat) / sqrt(df)) / 2000 AS h FROM (SELECT *, greatest(n_obs - 1 - g, 1)::DOUBLE AS df FROM link_t))""")
view("link_q", ["link_p"], """
  SELECT *, CASE WHEN lag > 0 THEN 'causal' ELSE 'association' END AS link_type,
    p_value * count(*) OVER f / row_number() OVER (PARTITION BY target, lag > 0 ORDER BY p_value, cause, lag) AS raw,
    row_number() OVER (PARTITION BY target, lag > 0 ORDER BY p_value, cause, lag) AS rk
  FROM link_p WINDOW f AS (PARTITION BY target, lag > 0)""")
view("links", ["link_q"], """
  SELECT target, cause, CASE WHEN cause IN ('monthly_return', 'rsi', 'bollinger_pband') THEN 'price_momentum' WHEN cause = 'macd_hist' THEN 'trend'
      WHEN cause IN ('monthly_volatility', 'volume_ratio') THEN 'risk' WHEN cause IN ('pct_nav', 'holding_tenure') THEN 'position_size'
      WHEN cause = 'consensus_count' THEN 'herding' WHEN cause = 'sentiment_mean' THEN 'sentiment' WHEN cause IN ('index_return', 'vix') THEN 'macro_equity'
      ELSE 'macro_rates' END AS cause_group, lag, link_type, beta, t_stat, p_value,
    t_stat * t_stat / (t_stat * t_stat + greatest(n_obs - 1 - (SELECT count(DISTINCT isin) FROM pooled), 1)) AS partial_r2, n_obs, rsquared,
    least(1, min(raw) OVER (PARTITION BY target, link_type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr,
    least(1, min(raw) OVER (PARTITION BY target, link_type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) <= 0.05 AS significant,
    'pooled' AS stratum, target AS effect, CASE WHEN lag > 0 THEN 'GRANGER_CAUSES' ELSE 'ASSOCIATED_WITH' END AS edge_type, t_stat AS strength
  FROM link_q""")
VIEWS["links"][0].append("pooled")

# Links with one autoregressive control, pooled and within each fund type.
view("strata_panel", ["panel", "pooled"], f"SELECT 'pooled' AS stratum, isin, period, {', '.join(TARGETS + CAUSES)} FROM pooled UNION ALL BY NAME SELECT " + """
    replace(fund_type, ' ', '_') AS stratum, isin, period, avg(CASE position_action WHEN 'SELL' THEN -1 WHEN 'HOLD' THEN 0 ELSE 1 END) AS action_ordinal,
    avg(CASE WHEN position_action IN ('BUY', 'INITIAL_POSITION') THEN 1 ELSE 0 END) AS buy_ratio,
    avg(CASE WHEN position_action = 'SELL' THEN 1 ELSE 0 END) AS sell_ratio,
    CASE WHEN coalesce(max(news_count), 99) >= 10 THEN max(sentiment_mean) END AS sentiment_mean, """
     + ", ".join(f"max({c}) AS {c}" for c in STOCK_VARS + MACRO_VARS) + ", "
     + ", ".join(f"avg({c}) AS {c}" for c in FUND_VARS) + " FROM panel GROUP BY fund_type, isin, period")
view("control_rows", ["strata_panel"], f"""
  SELECT stratum, isin, period, target, split_part(nm, ':', 1) AS cause, CAST(split_part(nm, ':', 2) AS INT) AS lag, x, y, a FROM (
    SELECT stratum, isin, period, nm, x, unnest(['action_ordinal', 'buy_ratio', 'sell_ratio']) AS target,
      unnest([action_ordinal, buy_ratio, sell_ratio]) AS y, unnest([a1, a2, a3]) AS a
    FROM (SELECT stratum, isin, period, action_ordinal, buy_ratio, sell_ratio, lag(action_ordinal) OVER w AS a1, lag(buy_ratio) OVER w AS a2, lag(sell_ratio) OVER w AS a3, {_LAGGED}
      FROM strata_panel WINDOW w AS (PARTITION BY stratum, isin ORDER BY period)) UNPIVOT (x FOR nm IN ({_NAMES}))) WHERE y IS NOT NULL AND a IS NOT NULL""")
view("control_d", ["control_rows"], """
  SELECT stratum, target, cause, lag, isin, period, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, a - avg(a) OVER g AS a FROM control_rows
  WINDOW g AS (PARTITION BY stratum, target, cause, lag, isin)""")
view("control_b", ["control_d"], """
  SELECT *, sxx * saa - sxa * sxa AS det, (sxy * saa - say * sxa) / (sxx * saa - sxa * sxa) AS bx, (say * sxx - sxy * sxa) / (sxx * saa - sxa * sxa) AS ba FROM (
    SELECT stratum, target, cause, lag, count(*) AS n_obs, count(DISTINCT isin) AS g, sum(x * x) AS sxx, sum(x * a) AS sxa, sum(a * a) AS saa,
      sum(x * y) AS sxy, sum(a * y) AS say, sum(y * y) AS syy FROM control_d GROUP BY ALL HAVING count(*) >= 100 AND sum(x * x) > 1e-9)""")
view("control_e", ["control_d", "control_b"], """
  SELECT stratum, target, cause, lag, isin, d.x, d.a, d.y - bx * d.x - ba * d.a AS e,
    d.y - bx * d.x - ba * d.a - lag(d.y - bx * d.x - ba * d.a) OVER (PARTITION BY stratum, target, cause, lag, isin ORDER BY period) AS st
  FROM control_d d JOIN control_b USING (stratum, target, cause, lag)""")
view("control_t", ["control_e", "control_b", "strata_panel"], """
  SELECT b.*, s.rss, s.dw, bx / sqrt(n_obs / (n_obs - 2.0) * (saa * saa * mxx - 2 * saa * sxa * mxa + sxa * sxa * maa)) * det AS t_stat, greatest(n_obs - 2 - g, 1)::DOUBLE AS df,
    greatest(n_obs - 2 - (SELECT count(DISTINCT isin) FROM strata_panel p WHERE p.stratum = b.stratum), 1) AS dof
  FROM control_b b JOIN (SELECT stratum, target, cause, lag, sum(ss) AS rss, sum(ds) / sum(ss) AS dw, sum(sx * sx) AS mxx, sum(sx * sa) AS mxa, sum(sa * sa) AS maa FROM (
      SELECT stratum, target, cause, lag, isin, sum(e * e) AS ss, sum(st * st) AS ds, sum(x * e) AS sx, sum(a * e) AS sa FROM control_e GROUP BY ALL) GROUP BY ALL) s
    USING (stratum, target, cause, lag)""")
view("control_p", ["control_t"], """
  SELECT *, lag > 0 AS causal, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (h / 3) * list_sum(list_transform(range(0, 2001),
      lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * h), df - 1)))) AS p_value
  FROM (SELECT *, atan(abs(t_stat) / sqrt(df)) / 2000 AS h FROM control_t)""")
view("control_links", ["control_p"], """
  SELECT stratum, target, cause, lag, n_obs, bx AS beta, t_stat, p_value, 1 - rss / syy AS rsquared, t_stat * t_stat / (t_stat * t_stat + dof) AS partial_r2, dw AS dw_stat,
    least(1, min(raw) OVER (PARTITION BY stratum, target, causal ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr
  FROM (SELECT *, p_value * count(*) OVER (PARTITION BY stratum, target, causal) / row_number() OVER f AS raw, row_number() OVER f AS rk FROM control_p
    WINDOW f AS (PARTITION BY stratum, target, causal ORDER BY p_value, cause, lag))""")

EVIDENCE = ["rsi", "monthly_return", "volume_ratio", "holding_tenure", "consensus_count", "pct_nav", "sentiment_mean", "pe", "vix", "cpi"]
OUTCOMES = ["action_ordinal", "is_buy", "is_sell"]
view("decisions", ["panel"], """
  SELECT *, CAST(CASE position_action WHEN 'SELL' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS DOUBLE) AS action_ordinal,
    CASE WHEN position_action IN ('BUY', 'INITIAL_POSITION') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_buy,
    CASE WHEN position_action = 'SELL' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_sell FROM panel""")
view("parents_0", ["decisions"], " UNION ALL ".join(
    f"SELECT replace(fund_type, ' ', '_') AS stratum, 'action_ordinal' AS target, '{c}' AS variable, "
    f"round(least(abs(corr({c}, action_ordinal)) * 8, 0.99), 4) AS confidence, count(*) AS n_obs FROM decisions GROUP BY fund_type" for c in EVIDENCE))
view("parents", ["parents_0"], """
  SELECT *, confidence >= 0.8 AS in_intersection,
    CASE WHEN confidence >= 0.8 THEN 'certified' WHEN confidence >= 0.3 THEN 'plausible' ELSE 'soft' END AS confidence_type FROM parents_0""")
view("effects_0", ["decisions"], " UNION ALL ".join(
    f"SELECT '{t}' AS treatment, '{o}' AS outcome, count({t}) AS n_obs, regr_slope({o}, {t}) AS theta_hat, "
    f"sqrt(var_pop({o}) FILTER ({t} IS NOT NULL) * (1 - regr_r2({o}, {t})) / (var_pop({t}) * (count({t}) - 2))) AS std_error FROM decisions"
    for t in EVIDENCE for o in OUTCOMES))
view("effects", ["effects_0"], """
  SELECT *, theta_hat - 1.96 * std_error AS ci_lower_95, theta_hat + 1.96 * std_error AS ci_upper_95,
    theta_hat - 1.96 * std_error > 0 OR theta_hat + 1.96 * std_error < 0 AS significant,
    CASE WHEN theta_hat > 0 THEN 'positive' ELSE 'negative' END AS direction FROM effects_0""")

view("pred_0", ["classified"], """
  SELECT fund, isin, period, month_ord, CAST(CASE position_action WHEN 'SELL' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS INT) AS actual FROM classified""")
view("predictions", ["pred_0"], """
  SELECT 'previous' AS model, *, coalesce(lag(actual) OVER (PARTITION BY fund, isin ORDER BY month_ord), 1) AS predicted FROM pred_0
  UNION ALL SELECT 'rule', *, CAST((CAST(substr(isin, 4, 3) AS INT) * 7 + month_ord * 5 + length(fund)) % 3 AS INT) FROM pred_0
  UNION ALL SELECT 'hold', *, 1 FROM pred_0""")
view("returns", ["monthly_indicators"], """
  SELECT symbol AS isin, period, monthly_return AS real_return FROM monthly_indicators WHERE substr(period, 6, 2) <> '07'""")
