"""Session helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, text, rest``: all other columns as one struct, so that none clashes with a name used on the way."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(None).cast("string").alias("none")])).alias("rest"))


def unpack_columns(packed: DataFrame, columns: list[str], counted: bool = False) -> DataFrame:
    """The columns that :func:`pack_columns` put away, in order; ``counted``: ``n_chars`` follows the text."""
    take = lambda c: F.col(c) if c in ("doc_id", "text") else F.length("text").cast("long").alias(c) if counted and c == "n_chars" else F.col(f"rest.`{c}`").alias(c)
    return packed.select(*[take(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system at a task's end: Python workers are reused, and what they keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable) -> Callable:
    """``f``, a function over one group or two (with their key), that releases memory once its arrays are gone: a worker that waits for its next task holds none of them."""

    def left(out):
        release()
        return out

    return {1: lambda part: left(f(part)), 2: lambda key, part: left(f(key, part)), 3: lambda key, one, two: left(f(key, one, two))}[f.__code__.co_argcount]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a session whose executors
    run on this machine takes a fresh temporary one; on a cluster that is an error, since executors
    would each write to a disk of their own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
