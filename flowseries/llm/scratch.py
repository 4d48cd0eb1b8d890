"""Tables written to cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one only where that is unset in local mode, as in
    tests: on a cluster executors wouldn't share it, so that fails."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='flowseries-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared folder and read it back: a lost executor then costs a re-read, not a
    recomputation, and the plan above starts from a scan. Also gives the path, for ``delete``."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``stored`` for a table that the result still reads."""
    return stored(df, tag)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of this session through Hadoop's file system, whatever store it is in."""
    if path.startswith(f"{scratch_dir(spark)}/"):
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
