"""Folders that driver and executors share, for tables that cut a lineage and for streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in spark.checkpoint.dir. Where that is unset and everything runs in one process, in a folder of our own; on
    a cluster a local folder would not be shared, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cellspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to a shared folder and read back."""
    at = shared_folder(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of our own in spark.checkpoint.dir that nothing reads any more."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
