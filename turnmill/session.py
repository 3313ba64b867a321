"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    # A table of few files is split among all cores as far as its row groups allow.
    "spark.sql.files.minPartitionNum": "64",
}


def build_session(app: str = "turnmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_RUN_FOLDERS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or beside the tables of the warehouse.

    Both can be reached from every executor, on a cluster and on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/turnmill-checkpoints"
    return named.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything. Other errors of a path are not hidden."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def run_folder(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables. Spark deletes it when the application ends."""
    run = spark.sparkContext.applicationId
    if run not in _RUN_FOLDERS:
        folder = f"{work_dir(spark)}/turnmill/{run}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUN_FOLDERS[run] = folder
    return _RUN_FOLDERS[run]


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    The written table cuts the lineage, survives a lost executor, and later readers prune its columns.
    """
    path = f"{run_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
