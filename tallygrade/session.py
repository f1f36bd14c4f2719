"""Session settings and the shared folder where long plans are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallygrade")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back on a folder of its own: on a cluster a
    machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # The setting cannot be changed in a running session, so the folder of a local one is kept here.
    name = spark.sparkContext.applicationId
    if name not in _LOCAL:
        _LOCAL[name] = tempfile.mkdtemp(prefix="tallygrade-")
    return _LOCAL[name]


#: Spark's setting that removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, free_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back.

    Used where one result feeds several later plans: the rows survive a lost
    executor, and the reader knows the real size when it picks a join. free_shuffles: what was
    shuffled for df is removed from the executors' disks once it is written, instead of when the driver next
    collects its garbage; for long chains of large tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if free_shuffles:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if free_shuffles:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
