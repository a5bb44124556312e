"""Cuts of long plans, written to the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Without one, a temporary folder, but only where all runs on one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmere-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage ends there, and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What a session, a pipeline or a query's warehouse is called in the checkpoint folder.
_OWN = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|(pipeline|warehouse)-[0-9a-f]{32}")


def remove_old(spark: SparkSession, older_than: float = 7 * 86_400) -> list[str]:
    """Remove what sessions that are gone have left in the checkpoint folder; gives the names.

    That is folders of this library's and Spark's naming in which nothing was
    added for so many seconds. A session that still runs removes its own as soon
    as nothing refers to them, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; that is only possible when it begins.
    """
    used = spark.sparkContext.getCheckpointDir() or ""  # a session's own folder in the shared one
    folder, own = used.rpartition("/")[0] or spark.conf.get("spark.checkpoint.dir", None), used.rpartition("/")[2]
    if not folder:
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    until = 1000 * (time.time() - older_than)
    found = [x for x in fs.listStatus(path) if x.getModificationTime() < until and _OWN.fullmatch(x.getPath().getName()) and x.getPath().getName() != own]
    for x in found:
        fs.delete(x.getPath(), True)
    return sorted(x.getPath().getName() for x in found)
