"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application.

    Spark's own file server hands it out, so no folder needs to be shared.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="furrow-"), "furrow_package.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, f"{top.name}/{path.relative_to(top)}")
    context.addPyFile(to)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set with setCheckpointDir.

    Where neither is set, a temporary one serves local mode; on a cluster, whose machines do
    not share it, that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="furrow-checkpoint-")
        spark.sparkContext.setCheckpointDir(given)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, for what a loop carries from round to round.

    A checkpoint keeps the size that the plan expects, for a join the product of both sides. Where each
    round joins what the last one left, the digits of that product grow by a factor a round, until
    planning takes longer than the work; files have a size of their own.
    """
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
