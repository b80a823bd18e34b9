"""Session settings and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on; all are also safe for other work.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above 8000 bytes; split such stages instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Only at start: no call-site capture for each column expression on the client.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


_single_process: dict[str, str] = {}


def builder(app_name: str = "threatlake") -> SparkSession.Builder:
    out = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **START_SETTINGS}.items():
        out = out.config(key, value)
    return out


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # Folders are listed by a few tasks a core: by default each of up to 10,000 folders is a task.
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Has `name` set for what runs inside, and what was set before for all that runs after.

    A scan takes the size of its splits when it runs: a size that is meant for one input must not stay
    set, or the tables landed from it are read in as many tiny tasks.
    """
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can write: `spark.checkpoint.dir`.

    Only a program whose executors are threads of its own, as in tests, may go without the
    setting; all its sessions then share one temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _single_process:
            _single_process[application] = tempfile.mkdtemp(prefix="threatlake-")
        folder = _single_process[application]
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    base = shared_folder(spark).rstrip("/")
    return f"{base}/threatlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def land(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as parquet to the shared folder and reads it back.

    Cuts the lineage, survives lost executors, and lets every later branch read
    only the columns it needs.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
