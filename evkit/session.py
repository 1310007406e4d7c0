"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# AQE picks broadcast joins from run-time sizes, splits skewed join partitions and merges small
# shuffle partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "evkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with RUNTIME_CONF and `conf`. Only here are settings made: sessions that a caller
    brings along keep theirs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Storage that all executors share: `spark.checkpoint.dir`, else the checkpoint folder of the
    context, else a folder in the warehouse. A warehouse on a local disk serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        house = spark.conf.get("spark.sql.warehouse.dir")
        if house.startswith(("file:", "/")) and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
        base = house.rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/evkit/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder of this application below the shared root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote to the shared root; its results must be read by then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(path, True))


def ensure_checkpoints(spark: SparkSession) -> None:
    """Long iterations (boosting) cut their lineage in the checkpoint folder; set one if there is none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark)}/checkpoints")


def write_once(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` to the scratch folder and read it back: later stages start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
