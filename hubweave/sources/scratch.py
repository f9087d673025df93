"""Tables that cut lineage between the rounds of an iteration."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; without it, a folder of a local session's own. ValueError on a cluster without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        import atexit

        _LOCAL[app] = tempfile.mkdtemp(prefix="hubweave-core-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return Path(_LOCAL[app]).as_uri()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the table outlives executors, its plan is a scan.

    The partitions stay as they are; the files stay until the folder is cleaned.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
