"""Stored layers: a frame written once to the folder all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a frame is stored: its shuffles are no use once it is there, so their files go with the job; code too long for
#: the JVM to compile (8,000 bytes a method) is not generated in one piece; rows that are sorted by a group's key already
#: are gathered as they come.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.replaceHashWithSortAgg": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where driver and executors are one machine may it be left unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unbroadcast(df: DataFrame) -> DataFrame:
    """df for joins that must not send it to the driver. Spark guesses sizes from compressed files, and an explode or
    short packed rows make far more of them, so what grows with the input is merged, whatever the guess."""
    return df.hint("merge")


@contextmanager
def storing(spark: SparkSession):
    """STORING for the jobs within."""
    before = {k: spark.conf.get(k, None) for k in STORING}
    try:
        for k, v in STORING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    path = path or f"{shared_dir(df.sparkSession)}/layers/{uuid.uuid4().hex}"
    with storing(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return unbroadcast(df.sparkSession.read.schema(df.schema).parquet(path))


_layers: dict[tuple[str, str, str], DataFrame] = {}


def layer(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The stored layer `name` of one input, built once an application: later queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _layers:
        _layers[key] = store(build())
    return _layers[key]


def stored_layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The layer if it has been built, else None."""
    return _layers.get((spark.sparkContext.applicationId, sf_dir, name))


def forget_layers() -> None:
    """Have every layer built anew where it is next asked for."""
    _layers.clear()
