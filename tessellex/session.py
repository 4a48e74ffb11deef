"""Session defaults and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessellex", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; values given in ``conf`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is empty and the master is local (tests) a temporary folder is used; on a
    cluster without the setting this raises, as a folder of one machine would not outlive it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessellex-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def kept_table(df: DataFrame) -> DataFrame:
    """The same as a compressed table, for rows with texts, which a checkpoint would write as they are.

    The table goes with the application, together with the checkpoints' folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the step that wrote them has ended, not when the driver happens to collect its garbage.

    For steps that end in ``cut`` or ``kept_table``; a frame made here that is run more than once makes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a test-data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
