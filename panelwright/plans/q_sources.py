"""Queries that go through files Spark writes from the tables, and the export layout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright.functions.encodings import action_class
from panelwright.operators import egonet as eg
from panelwright.operators import features as ft
from panelwright.operators.macro import union_all
from panelwright.plans import views as v
from panelwright.plans.registry import near_sql, query, rounded
from panelwright.plans.sqlviews import sql, view
from panelwright.session import shared_folder
from panelwright.sources import files as fs


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/panelwright/{spark.sparkContext.applicationId}/files-{name}-{uuid.uuid4().hex[:8]}"


@query("csv_round_trip", f"SELECT o_orderstatus, count(*) AS n, {near_sql('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1")
def csv_round_trip(spark, sf):
    """Delimited write, fallback path, stated-schema read, only needed columns (SRC1, SRC4, SRC9, SNK1)."""
    base = _folder(spark, "csv")
    fs.write_table(v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), f"{base}/orders", "csv")
    path = fs.first_existing(spark, [f"{base}/absent", f"{base}/orders"])
    d = fs.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")
    return rounded(d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("news_files", """
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'named' ELSE 'file' END AS family, count(*) AS n, count(DISTINCT doc_id % 28) AS n_dates FROM documents
    WHERE regexp_full_match(text, '[\\x00-\\x7F]*', 's') AND doc_id % 28 BETWEEN 3 AND 20 GROUP BY 1""")
def news_files(spark, sf):
    """News files with two header families in one folder, aliases, day-first dates, ASCII text only (SRC2, SRC3, FLT2, FLT3, SET1)."""
    base = _folder(spark, "news")
    day = F.concat(F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("-03-2024"))
    d = v.headlines(spark, sf)
    opts = {"header": True, "escape": '"', "quoteAll": True}
    d.where(F.col("doc_id") % 2 == 0).select(day.alias("published"), F.col("text").alias(" Headline "), F.col("source").alias("Publisher"), F.col("isin").alias("ticker")).write.options(**opts).csv(f"{base}/a")
    d.where(F.col("doc_id") % 2 == 1).select(F.col("text").alias("Title"), day.alias("DateTime")).write.mode("append").options(**opts).csv(f"{base}/a")  # other header, same folder
    d.select("doc_id", "lang").write.options(**opts).csv(f"{base}/c")  # no heading column: skipped
    n = fs.load_news(spark, [f"{base}/a", f"{base}/c"], "2024-03", "2024-03", multi_line=True)
    n = n.where(F.dayofmonth("Date").between(4, 21))
    return n.groupBy(F.when(F.startswith("Symbol", F.lit("INE")), "named").otherwise("file").alias("family")).agg(F.count("*").alias("n"), F.countDistinct("Date").alias("n_dates"))


@query("incremental_append", "SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY event_type")
def incremental_append(spark, sf):
    """Second load adds only unseen keys, once each although the batch repeats them (SRC10)."""
    base = _folder(spark, "inc")
    ev = v.table(spark, sf, "events").select("event_id", "event_type", "value")
    fs.append_new(ev.where(F.col("event_id") % 3 != 0), base, ["event_id"], "event_type")
    t = fs.append_new(ev.unionByName(ev), base, ["event_id"], "event_type")
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("json_documents", sql("SELECT position_action, count(*) AS n, max(holding_tenure)::BIGINT AS longest FROM classified GROUP BY 1", "classified"))
def json_documents(spark, sf):
    """Nested documents written as JSON and read back flat (SNK2)."""
    path = _folder(spark, "json")
    m = v.classified(spark, sf).groupBy("position_action").agg(F.count("*").alias("n"), F.max("holding_tenure").alias("longest"))
    fs.write_documents(m, path, F.struct("position_action", F.struct("n", "longest").alias("stats")))
    d = spark.read.schema("position_action string, stats struct<n:long, longest:long>").json(path)
    return d.select("position_action", "stats.n", "stats.longest")


@query("graph_upsert", sql(f"""
    SELECT substr(period, 1, 4) AS year, count(*) AS n, {near_sql("sum(CASE WHEN period >= '1999-01' THEN pct_nav * 2 ELSE pct_nav END)", 3)} AS weight,
      count(*) FILTER (period < '2001-01') AS with_action FROM panel GROUP BY 1""", "panel"))
def graph_upsert(spark, sf):
    """Keyed merge of edges: of repeated new rows the last counts, properties a new row lacks stay, years without new rows are not touched (SNK3)."""
    path = _folder(spark, "upsert")
    e = v.panel(spark, sf).select(F.lit("HOLDS").alias("etype"), F.col("fund").alias("src"), F.col("isin").alias("dst"), "period", F.col("pct_nav").alias("weight"), F.col("position_action").alias("action"))
    e = e.withColumn("year", F.substring("period", 1, 4))
    keys = ["etype", "src", "dst", "period", "year"]
    fs.upsert_table(e.where(F.col("period") < "2001-01"), path, keys, "year")
    later = e.where(F.col("period") >= "1999-01").drop("action")
    twice = later.withColumn("version", F.lit(1)).unionByName(later.withColumns({"weight": F.col("weight") * 2, "version": F.lit(2)}))
    t = fs.upsert_table(twice, path, keys, "year", ["version"])
    return rounded(t.groupBy(F.col("year").cast("string").alias("year")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.count("action").alias("with_action")), 3)


@query("union_by_name", sql("""
    SELECT symbol, count(*) AS n, count(volume) AS with_volume FROM (SELECT symbol, close, volume FROM bars WHERE month_ord % 2 = 0 UNION ALL SELECT symbol, close, NULL FROM bars WHERE month_ord % 2 = 1) GROUP BY symbol""", "bars"))
def union_by_name(spark, sf):
    """Union of frames with differing columns (SET1)."""
    b = v.bars(spark, sf)
    u = union_all([b.where(F.col("month_ord") % 2 == 0).select("symbol", "close", "volume"), b.where(F.col("month_ord") % 2 == 1).select("close", "symbol")])
    return u.groupBy("symbol").agg(F.count("*").alias("n"), F.count("volume").alias("with_volume"))


@query("stable_sample", sql("SELECT fund, isin, period, position_action FROM classified ORDER BY md5(fund || '|' || isin || '|' || period || '|42'), fund, isin, period LIMIT 500", "classified"))
def stable_sample(spark, sf):
    """Repeatable sample of 500 decisions (SMP1)."""
    return fs.stable_sample(v.classified(spark, sf).select("fund", "isin", "period", "position_action"), ["fund", "isin", "period"], 500)


@query("ml_export_edges", sql("""
    WITH p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM panel))
    SELECT dense_rank() OVER (ORDER BY fund) - 1 AS fund_idx, dense_rank() OVER (ORDER BY isin) - 1 AS stock_idx, i AS month_idx, CAST(CASE position_action WHEN 'SELL' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS INT) AS label,
      CASE WHEN i < floor(n * 0.65) THEN 'train' WHEN i < floor(n * 0.82 + 1e-9) THEN 'validation' ELSE 'test' END AS split, pct_nav, holding_tenure FROM panel JOIN p USING (period)""", "panel"))
def ml_export_edges(spark, sf):
    """Integer edge index, labels and split masks (GR18, WN26)."""
    p = ft.add_split(v.panel(spark, sf).select("fund", "isin", "period", "pct_nav", "holding_tenure", "position_action"))
    for col, out in (("fund", "fund_idx"), ("isin", "stock_idx"), ("period", "month_idx")):
        p = p.join(eg.sorted_index(p, col, out), col)
    return p.select("fund_idx", "stock_idx", "month_idx", action_class(F.col("position_action")).alias("label"), "split", "pct_nav", "holding_tenure")


@query("ml_export_nodes", sql(f"""
    SELECT fund, CASE WHEN contains(max(fund_type), 'small') THEN 1.0 ELSE 0.0 END AS is_small, CASE WHEN contains(max(fund_type), 'mid') THEN 1.0 ELSE 0.0 END AS is_mid,
      {near_sql('avg(pct_nav)', 4)} AS avg_pct_nav, {near_sql('avg(holding_tenure)', 4)} AS avg_tenure FROM panel GROUP BY fund""", "panel"))
def ml_export_nodes(spark, sf):
    """Fund feature frame (GR18)."""
    t = F.max("fund_type")
    f = v.panel(spark, sf).groupBy("fund").agg(
        F.when(F.contains(t, F.lit("small")), 1.0).otherwise(0.0).alias("is_small"), F.when(F.contains(t, F.lit("mid")), 1.0).otherwise(0.0).alias("is_mid"),
        F.avg("pct_nav").alias("avg_pct_nav"), F.avg("holding_tenure").alias("avg_tenure"),
    )
    return rounded(f, 4)
