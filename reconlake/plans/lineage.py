"""Cutting lineage in the folder that the cluster shares.

`spark.checkpoint.dir` names that folder. Where it is unset in local mode, as in
tests, a folder below the warehouse is used; on a cluster that is an error. Nothing is kept on one executor only, so a
lost executor costs a re-read and not the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, which is also Spark's checkpoint folder from now on."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and read back from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, path: str) -> DataFrame:
    """The rows of `df`, written to the folder and read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """As `cut`, but as a columnar table, so that later reads take only the columns they need."""
    return written_to(df, new_folder(df.sparkSession, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `new_folder` named, once all that was made of it is written."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError(f"{path} is not in the shared folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
