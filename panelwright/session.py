"""Session set-up, shared staging folder and the column check used by operators."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}


def local_session(cpus: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only when that is unset and the master is local (tests, bench) is a
    temporary folder made; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str, scope: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once per application to the shared folder and read it back.

    Used for the tables several consumers share. Readers get columnar files
    (pruning, pushdown) and a short lineage that survives executor loss.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    key = (app, f"{name}|{scope}")
    if key not in _STAGED:
        tag = hashlib.md5(scope.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark)}/panelwright/{app}/{name}-{tag}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def is_staged(spark: SparkSession, name: str, scope: str) -> DataFrame | None:
    """The staged table if this application already wrote it."""
    path = _STAGED.get((spark.sparkContext.applicationId, f"{name}|{scope}"))
    return spark.read.parquet(path) if path else None


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Raise a KeyError naming the columns an operator needs but did not get."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; got {df.columns}")
