"""Intermediate tables that outlive an executor.

Multi-pass operators write their intermediate results as Parquet below
``spark.checkpoint.dir``, the folder all executors share. A later pass reads the files
again, so a lost executor costs a task and not the lineage. Where the setting is absent
(tests, notebooks) one temporary folder per session takes its place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder of this process if none is set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.applicationId not in _OWN:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="kenmark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + _OWN[context.applicationId]


def own_folder(spark: SparkSession) -> str:
    """Below which this application writes."""
    return f"{scratch_dir(spark)}/kenmark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote; frames that still read it can't be used any more."""
    remove(spark, own_folder(spark))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as the cluster's file system sees it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table through the file system it lies on."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small new file, whole or not at all; FileExistsError if there is one of that name."""
    files, target = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise FileExistsError(path)


def names_below(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none if it doesn't exist."""
    files, target = _file_system(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []
