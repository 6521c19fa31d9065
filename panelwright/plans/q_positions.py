"""Queries over the holdings layer: decisions, holding periods, exits, ranks, keys, text rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import cleaning as cl
from panelwright.functions import periods as pr
from panelwright.functions import rules as ru
from panelwright.operators import positions as ps
from panelwright.operators import skew
from panelwright.plans import views as v
from panelwright.plans.registry import query, round_sql, rounded
from panelwright.plans.sqlviews import sql


@query("position_action_mix", sql("""
    SELECT position_action, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
    FROM classified GROUP BY position_action""", "classified"))
def position_action_mix(spark, sf):
    """Flagship: classify every holding row, then the share of each action (WN2, AG23)."""
    df = v.classified(spark, sf).groupBy("position_action").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # four rows
    return df.withColumn("pct", F.round(100.0 * F.col("n") / total, 6))


@query("classify_positions", sql(f"""
    SELECT fund, isin, period, position_action, CAST(month_gap AS INT) AS month_gap, quantity_change,
      {round_sql('allocation_change size')}, holding_period_id, holding_tenure FROM classified""", "classified"))
def classify_positions(spark, sf):
    """Decision label, change fields, holding period id and tenure (WN2, WN3, WN4)."""
    df = ps.classify_positions(v.holdings(spark, sf))
    return df.select(
        "fund", "isin", "period", "position_action", "month_gap", "quantity_change",
        (F.round("allocation_change", 6) + F.lit(0.0)).alias("allocation_change"),
        (F.round("size", 6) + F.lit(0.0)).alias("size"), "holding_period_id", "holding_tenure",
    )


@query("holding_periods", sql("""
    SELECT holding_period_id, count(*) AS months, max(holding_tenure) AS tenure, min(period) AS opened, max(period) AS last_seen
    FROM classified GROUP BY holding_period_id""", "classified"))
def holding_periods(spark, sf):
    """One row per holding period: length, first and last month (WN3, WN4)."""
    return v.classified(spark, sf).groupBy("holding_period_id").agg(
        F.count("*").alias("months"),
        F.max("holding_tenure").alias("tenure"),
        F.min("period").alias("opened"),
        F.max("period").alias("last_seen"),
    )


@query("exit_events", sql("""
    SELECT fund, isin, sector, period AS exit_month, pct_nav AS last_pct_nav, quantity AS last_quantity, holding_tenure
    FROM (SELECT *, lead(month_ord) OVER (PARTITION BY fund, isin ORDER BY month_ord) AS nxt,
                 max(month_ord) OVER (PARTITION BY fund) AS fund_last FROM classified)
    WHERE coalesce(nxt, fund_last) - month_ord > 3""", "classified"))
def exit_events(spark, sf):
    return ps.detect_exits(v.classified(spark, sf))


@query("fund_rank_top10", sql("""
    SELECT fund, isin, period, pct_nav, rank() OVER (PARTITION BY fund, period ORDER BY pct_nav DESC) AS rank_in_fund,
      CASE WHEN rank() OVER (PARTITION BY fund, period ORDER BY pct_nav DESC) <= 10 THEN 1 ELSE 0 END AS is_top10
    FROM holdings""", "holdings"))
def fund_rank_top10(spark, sf):
    df = v.holdings(spark, sf).select("fund", "isin", "period", "pct_nav")
    return ps.add_rank(df)


@query("breadth_and_consensus", sql("""
    SELECT fund, isin, period, count(*) OVER (PARTITION BY fund, period) AS fund_stock_count,
      round(sum(pct_nav) OVER (PARTITION BY fund, period, sector), 6) AS sector_weight,
      count(*) OVER (PARTITION BY isin, period) AS consensus_count
    FROM holdings""", "holdings"))
def breadth_and_consensus(spark, sf):
    df = ps.add_breadth(v.holdings(spark, sf).select("fund", "isin", "period", "sector", "pct_nav"))
    return df.select("fund", "isin", "period", "fund_stock_count", F.round("sector_weight", 6).alias("sector_weight"), "consensus_count")


@query("allocation_quintile", sql("""
    WITH e AS (SELECT fund, period, list_transform(quantile_cont(pct_nav, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 9)) AS q
               FROM holdings GROUP BY fund, period)
    SELECT h.fund, h.isin, h.period, CAST(CASE WHEN len(list_distinct(q)) < 6 THEN 3 WHEN pct_nav <= q[2] THEN 1
      WHEN pct_nav <= q[3] THEN 2 WHEN pct_nav <= q[4] THEN 3 WHEN pct_nav <= q[5] THEN 4 ELSE 5 END AS INT) AS allocation_quintile
    FROM holdings h JOIN e USING (fund, period)""", "holdings"))
def allocation_quintile(spark, sf):
    df = ps.add_quintile(v.holdings(spark, sf).select("fund", "isin", "period", "pct_nav"))
    return df.select("fund", "isin", "period", "allocation_quintile")


@query("modal_part_name", sql("""
    SELECT isin, p_name FROM (
      SELECT isin, p_name, row_number() OVER (PARTITION BY isin ORDER BY count(*) DESC, p_name) AS rn
      FROM (SELECT 'INE' || lpad(replace(p_brand, 'Brand#', ''), 3, '0') AS isin, p_name FROM part) GROUP BY isin, p_name)
    WHERE rn = 1"""))
def modal_part_name(spark, sf):
    """Most common name per stock id (AG3)."""
    part = v.table(spark, sf, "part").select(v.isin_of(v.brand_number(F.col("p_brand"))).alias("isin"), "p_name")
    return ps.modal_value(part, "isin", "p_name")


@query("dedup_keep_latest", sql("""
    SELECT l_suppkey, isin, period, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, isin, period
        ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lines) WHERE rn = 1""", "lines"))
def dedup_keep_latest(spark, sf):
    """Latest record per fund, stock and month (AG4)."""
    order = [F.col("l_shipdate").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]]
    df = skew.keep_one(v.lines(spark, sf), ["l_suppkey", "isin", "period"], order)
    return df.select("l_suppkey", "isin", "period", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


_RAW_SQL = """
  raw AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate,
    CASE WHEN l_orderkey % 11 = 0 THEN 'n.a.' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS qty_text,
    CASE WHEN l_orderkey % 13 = 0 THEN 'unknown' WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%d-%m-%Y')
         ELSE strftime(l_shipdate, '%d/%m/%Y') END AS date_text FROM lineitem)"""


def _raw_text(spark, sf):
    """Line items as untyped text: day-first dates in two layouts, some unusable cells."""
    li = v.table(spark, sf, "lineitem")
    ts = F.col("l_shipdate")
    dd, mm, yy = F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"), F.lpad(F.month(ts).cast("string"), 2, "0"), F.year(ts).cast("string")
    return li.withColumns(
        {
            "qty_text": F.when(F.col("l_orderkey") % 11 == 0, "n.a.").otherwise(F.col("l_quantity").cast("int").cast("string")),
            "date_text": F.when(F.col("l_orderkey") % 13 == 0, "unknown")
            .when(F.col("l_orderkey") % 2 == 0, F.concat_ws("-", dd, mm, yy))
            .otherwise(F.concat_ws("/", dd, mm, yy)),
        }
    )


@query("typed_from_text", f"""WITH {_RAW_SQL}
    SELECT strftime(l_shipdate, '%Y-%m') AS month_key, CAST(count(TRY_CAST(qty_text AS DOUBLE)) AS BIGINT) AS usable_quantity,
      coalesce(sum(TRY_CAST(qty_text AS DOUBLE)), 0) AS quantity,
      count(CASE WHEN date_text <> 'unknown' THEN 1 END) AS usable_dates,
      CAST(max(CASE WHEN date_text <> 'unknown' THEN CAST(l_shipdate AS DATE) END) AS VARCHAR) AS last_date, count(*) AS n
    FROM raw GROUP BY 1""")
def typed_from_text(spark, sf):
    """Numeric coercion and day-first dates, bad text missing (PRJ1, PRJ2, FLT4)."""
    df = _raw_text(spark, sf).withColumns(
        {"q": cl.to_number(F.col("qty_text")), "d": pr.parse_day_first(F.col("date_text"), ["dd-MM-yyyy", "dd/MM/yyyy"])}
    )
    return df.groupBy(pr.period_key(F.col("l_shipdate")).alias("month_key")).agg(
        F.count("q").alias("usable_quantity"),
        F.coalesce(F.sum("q"), F.lit(0.0)).alias("quantity"),
        F.count("d").alias("usable_dates"),
        F.max("d").cast("string").alias("last_date"),
        F.count("*").alias("n"),
    )


@query("clean_raw_holdings", sql("""
    SELECT fund, isin, period, d AS date, pct_nav, market_value, quantity, sector FROM (
      SELECT *, row_number() OVER (PARTITION BY fund, isin, period ORDER BY d DESC, market_value DESC, quantity DESC, pct_nav DESC) AS rn
      FROM (SELECT l_suppkey AS fund, isin, period, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, l_extendedprice / 1000 AS pct_nav,
              l_extendedprice AS market_value, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS quantity,
              CASE p_type WHEN 'PROMO' THEN 'HEALTHCARE' WHEN 'ECONOMY' THEN 'FINANCIAL SERVICES' WHEN 'MEDIUM' THEN 'ENERGY'
                ELSE 'OTHERS' END AS sector
            FROM lines JOIN part p ON l_partkey = p_partkey
            WHERE l_orderkey % 13 <> 0 AND l_linenumber <> 3 AND l_returnflag <> 'R')) WHERE rn = 1""", "lines"))
def clean_raw_holdings(spark, sf):
    """Text rows cleaned to the unique fund, stock, month panel (SRC3, PRJ1-3, PRJ5, FLT1, FLT4, AG4)."""
    raw = _raw_text(spark, sf)
    part = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    names = cl.to_map({"PROMO": " Pharmaceuticals ", "ECONOMY": '"Banks - private"', "MEDIUM": "Oil"}, F.col("p_type"), "Diversified")
    code = F.when(F.col("l_returnflag") == "R", F.lit("XX0")).otherwise(F.lit(" INE"))
    raw = raw.join(part, "l_partkey").select(
        F.col("l_suppkey").alias("fund"),
        F.concat(code, F.lpad(v.brand_number(F.col("p_brand")).cast("string"), 3, "0"), F.lit(" ")).alias("isin"),
        F.col("date_text").alias("date"),
        F.when(F.col("l_linenumber") == 3, F.lit("-1")).otherwise((F.col("l_extendedprice") / 1000).cast("string")).alias("pct_nav"),
        F.col("l_extendedprice").cast("string").alias("market_value"),
        F.col("qty_text").alias("quantity"),
        names.alias("industry"),
    )
    df = ps.clean_holdings(raw)
    return df.select("fund", "isin", "period", F.col("date").cast("string").alias("date"), "pct_nav", "market_value", "quantity", "sector")


@query("calendar_keys", """
    SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_ord,
      'Q' || CAST((month(o_orderdate) - 1) // 3 + 1 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS quarter,
      'FY' || CAST(CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS VARCHAR) AS fiscal_year,
      count(*) AS n, CAST(last_day(max(o_orderdate)) AS VARCHAR) AS month_end
    FROM orders GROUP BY 1, 2, 3, 4""")
def calendar_keys(spark, sf):
    """Month key, ordinal, quarter, fiscal year, month end (PRJ3, PRJ4)."""
    ts = F.col("o_orderdate")
    df = v.table(spark, sf, "orders").groupBy(pr.period_key(ts).alias("period"), pr.month_ordinal(ts).alias("month_ord")).agg(
        F.count("*").alias("n"), F.last_day(F.max(ts).cast("date")).cast("string").alias("month_end")
    )
    p = F.col("period")
    return df.withColumns({"quarter": pr.quarter_label(p), "fiscal_year": pr.fiscal_year(p)})


_INDUSTRY_TEXT = {
    "PROMO": "Pharma", "ECONOMY": "Bank", "MEDIUM": "Oil and gas", "LARGE": "IT - Services", "SMALL": "Food", "STANDARD": "Telecom",
}


@query("industry_sectors", f"""
    WITH t AS (SELECT p_partkey, upper(trim(CASE p_type WHEN 'PROMO' THEN 'Pharma' WHEN 'ECONOMY' THEN 'Bank' WHEN 'MEDIUM' THEN 'Oil and gas'
      WHEN 'LARGE' THEN 'IT - Services' WHEN 'SMALL' THEN 'Food' ELSE 'Telecom' END || CASE p_size % 5 WHEN 0 THEN ' power' WHEN 1 THEN ' mining'
      WHEN 2 THEN ' auto parts' WHEN 3 THEN '' ELSE ' retail' END)) AS s, p_size FROM part),
    u AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 10 = 0 THEN 'N.A.' WHEN p_size % 7 = 0 THEN substr(s, 5) ELSE s END AS s FROM t)
    SELECT {ru.rules_sql('s', ru.INDUSTRY_RULES, 'OTHERS')} AS sector, count(*) AS n, min(p_partkey) AS first_part FROM u GROUP BY 1""")
def industry_sectors(spark, sf):
    """Keyword sector of a free-text industry (PRJ5)."""
    extra = cl.to_map({0: " power", 1: " mining", 2: " auto parts", 3: "", 4: " retail"}, F.col("p_size") % 5)
    raw = F.concat(cl.to_map(_INDUSTRY_TEXT, F.col("p_type")), extra)
    raw = (
        F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("string"))
        .when(F.col("p_size") % 10 == 0, F.lit(' "n.a."'))
        .when(F.col("p_size") % 7 == 0, F.substring(raw, 5, 100))
        .otherwise(raw)
    )
    df = v.table(spark, sf, "part").select("p_partkey", ru.industry_sector(raw).alias("sector"))
    return df.groupBy("sector").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("action_encodings", sql("""
    SELECT position_action, CASE position_action WHEN 'SELL' THEN -1 WHEN 'HOLD' THEN 0 ELSE 1 END AS signed_action,
      CASE position_action WHEN 'SELL' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS action_class,
      CASE WHEN position_action IN ('BUY', 'INITIAL_POSITION') THEN 1.0 ELSE 0.0 END AS is_buy,
      CASE WHEN position_action = 'SELL' THEN 1.0 ELSE 0.0 END AS is_sell, count(*) AS n
    FROM classified GROUP BY ALL""", "classified"))
def action_encodings(spark, sf):
    """Signed and class encodings with the binary targets (PRJ7, PRJ8)."""
    from panelwright.functions.encodings import action_class, is_buy, is_sell, signed_action

    a = F.col("position_action")
    df = v.classified(spark, sf).groupBy("position_action").agg(F.count("*").alias("n"))
    return df.withColumns(
        {"signed_action": signed_action(a), "action_class": action_class(a), "is_buy": is_buy(a), "is_sell": is_sell(a)}
    )


@query("text_filters", """
    SELECT lang, count(*) AS n, count(CASE WHEN regexp_full_match(text, '[\\x00-\\x7F]*', 's') THEN 1 END) AS ascii_docs,
      count(CASE WHEN regexp_full_match(source, 'src1[0-9]') THEN 1 END) AS coded, count(CASE WHEN starts_with(upper(trim(text)), 'TH') THEN 1 END) AS prefixed,
      max(substr(replace(replace(replace(source || ' a/b&c and more text', ' ', '_'), '&', 'n'), '/', '_'), 1, 15)) AS safe_id
    FROM documents GROUP BY lang""")
def text_filters(spark, sf):
    """ASCII filter, code pattern, prefix, text key and safe identifier (FLT1, FLT2, PRJ17)."""
    d = v.table(spark, sf, "documents")
    return d.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count(F.when(cl.is_ascii(F.col("text")), 1)).alias("ascii_docs"),
        F.count(F.when(F.col("source").rlike("^src1[0-9]$"), 1)).alias("coded"),
        F.count(F.when(F.startswith(cl.text_key(F.col("text")), F.lit("TH")), 1)).alias("prefixed"),
        F.max(cl.safe_identifier(F.concat(F.col("source"), F.lit(" a/b&c and more text")))).alias("safe_id"),
    )


@query("range_and_membership", sql("""
    SELECT isin, count(*) AS n, round(sum(pct_nav), 4) AS weight FROM holdings h
    WHERE period BETWEEN '1996-01' AND '1999-12' AND isin IN (SELECT isin FROM fundamentals WHERE pe > 45)
    GROUP BY isin HAVING count(*) >= 30""", "holdings", "fundamentals"))
def range_and_membership(spark, sf):
    """Inclusive range, membership in another set, and groups with too few rows dropped (FLT3, FLT5, FLT6)."""
    from panelwright.operators.bars import drop_short_series

    h = v.holdings(spark, sf).where(F.col("period").between("1996-01", "1999-12"))
    keep = v.fundamentals(spark, sf).where(F.col("pe") > 45).select("isin").distinct()
    h = drop_short_series(h.join(keep, "isin", "left_semi"), ["isin"], 30)
    return h.groupBy("isin").agg(F.count("*").alias("n"), F.round(F.sum("pct_nav"), 4).alias("weight"))


@query("data_audit", sql("""
    WITH ready AS (SELECT fund, isin, period FROM holdings WHERE period >= '1995-06'),
    raw AS (SELECT *, CASE WHEN (CAST(quantity AS BIGINT) % 4) = 0 THEN NULL ELSE pct_nav END AS nav FROM holdings),
    starts AS (SELECT fund, min(period) FILTER (nav IS NOT NULL) AS true_start FROM raw GROUP BY fund),
    r AS (SELECT fund, min(period) AS ready_start, count(*) AS n_ready FROM ready GROUP BY fund),
    syn AS (SELECT x.fund, count(*) FILTER (w.nav IS NULL) AS n_synthetic FROM ready x LEFT JOIN raw w USING (fund, isin, period) GROUP BY x.fund)
    SELECT fund, true_start, ready_start, ready_start < true_start AS backfilled, n_ready, n_synthetic,
      round(100.0 * n_synthetic / n_ready, 6) AS synthetic_pct
    FROM starts JOIN r USING (fund) JOIN syn USING (fund)""", "holdings"))
def data_audit(spark, sf):
    """First true month per fund, backfill flag and share of filled-in rows (AG31, JN18)."""
    from panelwright.operators.reports import authenticity_audit

    h = v.holdings(spark, sf)
    raw = h.withColumn("nav", F.when(F.col("quantity").cast("long") % 4 != 0, F.col("pct_nav")))
    ready = h.where(F.col("period") >= "1995-06").select("fund", "isin", "period")
    return authenticity_audit(raw, ready, "fund", ["fund", "isin", "period"], "nav")
