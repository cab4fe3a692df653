"""Tables that cut a long plan, kept where every executor can read them.

An iterative operator writes each step with :func:`cut` and reads it again, so a
lost executor costs one step and not the whole history.  The folder is the one the
cluster names in ``spark.checkpoint.dir``; only when that is unset and driver and executors
are one process (tests, notebooks) is one made for the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_quern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the checkout the driver uses."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark
