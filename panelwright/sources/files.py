"""Readers and writers: headers that drift, fallbacks, incremental loads, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import periods as pr
from panelwright.functions.cleaning import is_ascii
from panelwright.operators.macro import union_all
from panelwright.operators.skew import keep_one
from panelwright.session import staged

# A merged partition is written as at most so many files.
FILES_PER_PARTITION = 8

# Header aliases of news files.
NEWS_ALIASES = {
    "Date": ["date", "published", "datetime"],
    "Heading": ["heading", "headline", "title", "text"],
    "Source": ["source", "publisher"],
    "Symbol": ["symbol", "ticker", "stock"],
}


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """One delimited source with a stated schema; files with line feeds in fields need ``multi_line``."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=multi_line)


def rename_by_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Strip headers and map known synonyms to one name."""
    known = {a: name for name, names in aliases.items() for a in names}
    return df.withColumnsRenamed({c: known.get(c.strip().lower(), c.strip()) for c in df.columns})


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """First path of a fallback chain that exists."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def files_by_header(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Paths of a folder's text files by their first line (one row per file is collected)."""
    lines = spark.read.text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value"
    )
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "row").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("path").collect():
        out.setdefault(r["header"], []).append(r["path"])
    return out


def load_news(spark: SparkSession, folders: list[str], start: str | None = None, end: str | None = None, multi_line: bool = False) -> DataFrame:
    """News files of several header families as (Symbol, Date, Heading, Source, file_name).

    Files of one folder may differ in their headers: those with the same
    header line are read as one scan. A header without a heading column is
    skipped, one that has two columns for the same name is an error; a missing
    symbol becomes the file name, text with non-ASCII characters is dropped.
    Ask for ``multi_line`` if quoted fields hold line feeds; such files cannot
    be split.
    """
    frames = []
    for folder in folders:
        for header, paths in files_by_header(spark, folder).items():
            df = spark.read.csv(paths, header=True, escape='"', multiLine=multi_line)
            df = rename_by_aliases(df.withColumn("file_name", F.regexp_replace("_metadata.file_name", "\\.csv$", "")), NEWS_ALIASES)
            twice = {c for c in df.columns if df.columns.count(c) > 1}
            if twice:
                raise ValueError(f"header {header!r} in {folder} has several columns for {sorted(twice)}")
            if "Heading" not in df.columns:
                continue
            for c in ("Date", "Source", "Symbol"):
                if c not in df.columns:
                    df = df.withColumn(c, F.col("file_name") if c == "Symbol" else F.lit(None).cast("string"))
            frames.append(df.select("Symbol", "Date", "Heading", "Source", "file_name"))
    if not frames:
        raise ValueError(f"no file with a heading column in {folders}")
    out = union_all(frames).withColumn("Date", pr.parse_day_first(F.col("Date")))
    out = out.where(F.col("Date").isNotNull() & is_ascii(F.col("Heading")))
    if start and end:
        out = out.where(F.col("Date").between(F.to_date(F.lit(start + "-01")), F.last_day(F.to_date(F.lit(end + "-01")))))
    return out


def not_yet_processed(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been handled before (incremental resume)."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(new: DataFrame, path: str, keys: list[str], partition_by: str) -> DataFrame:
    """Append only unseen keys to a partitioned table and return the whole table.

    Of rows with one key in a batch the first by all columns stays. A key
    belongs to one partition, so only partitions of the batch are read.
    """
    spark = new.sparkSession
    new = keep_one(new, keys, [F.col(c) for c in new.columns if c not in keys] or [F.lit(1)])
    if path_exists(spark, path):
        parts = new.select(partition_by).distinct()
        new = not_yet_processed(new, spark.read.parquet(path).join(parts, partition_by, "left_semi"), keys)
    new.write.mode("append").partitionBy(partition_by).parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(partition_by) if partition_by else w).save(path)


def write_documents(df: DataFrame, path: str, body: Column | None = None) -> None:
    """One JSON document per row."""
    out = df if body is None else df.select(F.to_json(body).alias("value"))
    (out.write.mode("overwrite").json(path) if body is None else out.write.mode("overwrite").text(path))


def upsert_table(new: DataFrame, path: str, keys: list[str], partition_by: str, latest: list[str] | None = None) -> DataFrame:
    """Keyed merge into a partitioned table; only partitions that ``new`` touches are read and replaced.

    ``partition_by`` must be one of the keys, so that a key lives in one
    partition. The merged rows are written beside the table first and then
    replace their partitions in one commit: files of other partitions stay as
    they are, and a failure before the commit leaves the old table. Columns
    that ``new`` adds are NULL in partitions it does not touch.
    """
    from panelwright.operators.graph import upsert

    if partition_by not in keys:
        raise ValueError(f"the partition column {partition_by} must be one of the keys {keys}")
    spark = new.sparkSession
    if path_exists(spark, path):
        old = spark.read.option("mergeSchema", True).parquet(path)
        old = old.withColumn(partition_by, F.col(partition_by).cast(new.schema[partition_by].dataType))
        touched = new.select(F.col(partition_by).alias("_touched")).distinct()
        old = old.join(touched, F.col(partition_by).eqNullSafe(F.col("_touched")), "left_semi")
    else:
        old = new.limit(0)
    merged = staged(upsert(old, new, keys, latest), "merge", f"{path}|{uuid.uuid4().hex}")
    # a row per file and partition: the rows of a partition come together before they are written
    merged.repartition(F.col(partition_by), F.pmod(F.xxhash64(*keys), F.lit(FILES_PER_PARTITION))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition_by).parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def stable_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample: the ``n`` rows with the smallest seeded digest of their key."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))))
    return df.withColumn("_h", digest).orderBy("_h", *keys).limit(n).drop("_h")
