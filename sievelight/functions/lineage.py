"""Cutting lineage: a table in the shared folder instead of a plan that is computed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a session within one machine (``local``) gets a temporary folder, which becomes the setting; on a
    cluster executors share no such folder, so the setting is demanded.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def fresh_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/sievelight-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a lost executor then costs one stage.

    The table is deleted by ``forget``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that no plan needs any more."""
    for df in tables:
        files, place = _place(df.sparkSession, df._cut_to)
        files.delete(place, True)
