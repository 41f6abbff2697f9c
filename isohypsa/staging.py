"""Cutting lineage on shared storage.

Intermediate tables that several later steps read are written once to the folder the cluster
names in ``spark.checkpoint.dir``, so a lost executor costs a re-read, not a recomputation of the
whole chain. Only a local session may go without that setting; it gets a private folder.

Tables staged inside ``with scoped(spark):`` are deleted at its end, whatever other streams or batches
stage meanwhile: write the result inside."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="isohypsa-checkpoint-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and continue from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[list[str]]:
    """Collects what is staged in this context and deletes it at the end."""
    staged: list[str] = []
    token = _SCOPE.set(staged)
    try:
        yield staged
    finally:
        _SCOPE.reset(token)
        for path in staged:
            delete(spark, path)


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)
