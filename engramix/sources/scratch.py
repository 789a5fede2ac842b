"""Intermediate results that several branches of a plan need: written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared folder. Only where the session names none (one machine) a temporary one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="engramix-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new folder's name below the shared folder."""
    return f"{_folder(spark)}/engramix-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read from there, so lineage ends and lost executors cost only their tasks."""
    _folder(df.sparkSession)
    return df.checkpoint()
