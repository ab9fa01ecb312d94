"""Writing results (K1-K7). Spark's commit protocol makes a table visible only when its job is complete."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallymark.operators.publish import differences
from tallymark.operators.validate import EvidenceError


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: in ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors run on this machine takes a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise EvidenceError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read to the shared folder, and read it back.

    The result is computed once, has no lineage to repeat, and survives lost executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write an immutable table (K1): one that is there already must hold the same rows."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
    elif not differences(spark.read.parquet(path), df).isEmpty():
        raise EvidenceError(f"{path} holds other rows")


def append_runs(runs: DataFrame, path: str) -> None:
    """Append committed runs, partitioned by plan, so that filters on it skip files (K6)."""
    runs.write.mode("append").partitionBy("plan_id").parquet(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """The expanded run matrix by repetition (K5)."""
    matrix.write.mode("errorifexists").partitionBy("repetition").parquet(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """An evidence document: one dataset a section (K2, K4)."""
    for name, df in sections.items():
        write_once(df, f"{path}/{name}")


def write_campaign_index(counts: DataFrame, path: str, keys: list[str]) -> None:
    """Status counts by plan, platform and environment (K7)."""
    counts.write.mode("overwrite").partitionBy(*keys).parquet(path)
