"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "creaseline", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        # recording the call site of every column costs more than planning does
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every query relies on; cluster sizing is left to the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a skewed join side even where that costs another shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may run without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        # "local-cluster" has executors with folders of their own
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        base = _fallback.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="creaseline-"))
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/creaseline-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so several consumers share one evaluation."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
