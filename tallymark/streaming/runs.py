"""Incremental ingest of committed runs, statistics that the stream keeps, and attempts.

Every batch writes to folders of its own number, and what it adds up comes from folders of smaller numbers: a batch that is replayed after a crash
writes the same again. The folders are the ledger; nothing is counted twice and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallymark.operators.metrics import rounded
from tallymark.sources.sinks import exists

#: Every so many versions hold all cells; the others only those that their batch changed.
SNAPSHOT = 50
MOMENTS = ("n", "mean", "m2", "least", "largest")


class Cells(NamedTuple):
    """Running statistics that a stream keeps: of the number ``value`` by ``keys``, in the folder ``path``."""

    path: str
    keys: Sequence[str]
    value: str


def moments(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mergeable statistics of each cell: count, mean, sum of squared deviations, least and largest value; null values are not counted."""
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("least"), F.max(v).alias("largest"))


def merged(one: DataFrame, two: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Statistics of both tables' rows together, for the cells that the join ``how`` gives."""
    right = two.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(m).alias(f"_{m}") for m in MOMENTS])
    same = F.lit(True)
    for k in keys:
        same = same & one[k].eqNullSafe(F.col(f"_{k}"))
    joined = one.withColumn("_one", F.lit(True)).join(right, same, how)
    a, b = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0))
    apart = F.col("_mean") - F.col("mean")
    mean = F.when(b == 0, F.col("mean")).when(a == 0, F.col("_mean")).otherwise(F.col("mean") + apart * b / (a + b))
    m2 = F.coalesce("m2", F.lit(0.0)) + F.coalesce("_m2", F.lit(0.0)) + F.coalesce(apart * apart * a * b / (a + b), F.lit(0.0))
    named = [F.when(F.col("_one"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    return joined.select(*named, (a + b).alias("n"), mean.alias("mean"), m2.alias("m2"), F.least("least", "_least").alias("least"), F.greatest("largest", "_largest").alias("largest"))


def _complete(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions under ``path`` whose job is complete."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def _latest(spark: SparkSession, path: str, keys: Sequence[str], versions: Sequence[int]) -> DataFrame | None:
    """Each cell as its greatest version has it, from the last snapshot on."""
    used = [v for v in versions if v >= max(versions) // SNAPSHOT * SNAPSHOT]
    if not used:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in used])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*MOMENTS), "version").alias("_m")).select(*keys, "_m.*")


def keep_moments(rows: DataFrame, cells: Cells, batch_id: int) -> None:
    """Add a batch's rows to the statistics, as version ``batch_id``: written anew from the versions before it, however often the batch comes."""
    spark = rows.sparkSession
    new = moments(rows, cells.keys, cells.value)
    before = [v for v in _complete(spark, cells.path) if v < batch_id]
    if before:
        new = merged(new, _latest(spark, cells.path, cells.keys, before), cells.keys, "left" if batch_id % SNAPSHOT else "full_outer")
    new.coalesce(1 if batch_id % SNAPSHOT else 8).write.mode("overwrite").parquet(f"{cells.path}/version={batch_id}")


def read_cells(spark: SparkSession, cells: Cells) -> DataFrame:
    """The statistics of all complete batches: keys, n, mean, sample_std (null below two), least and largest."""
    now = _latest(spark, cells.path, cells.keys, _complete(spark, cells.path))
    return now.select(*cells.keys, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("sample_std"), "least", "largest")


def stream_committed_runs(
    spark: SparkSession, path: str, schema: StructType, target: str, checkpoint: str, condition: str = "committed", key: str = "run_key", files_per_batch: int = 100, cells: Cells | None = None
) -> StreamingQuery:
    """Append each committed run of ``path`` to the table ``target`` once, whatever is delivered again (R1), and keep ``cells``' statistics of them.

    A batch drops its own repeats and those that earlier batches have, by an anti-join on the key; the table, which gets a column ``batch``,
    is the state, so none grows in memory. Returns the started query; it ends when all files are read.
    """
    stored = StructType([*schema.fields, StructField("batch", LongType())])

    def ingest(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter(condition).dropDuplicates([key])
        session = batch.sparkSession
        if exists(session, target):
            new = new.join(session.read.schema(stored).parquet(target).filter(F.col("batch") < batch_id).select(key), key, "left_anti")
        new.select(*schema.names).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if cells is not None:
            keep_moments(session.read.schema(schema).parquet(f"{target}/batch={batch_id}"), cells, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cell_statistics(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per-cell counts, sums, least and largest values and means of ingested runs; sums add up over batches."""
    v = F.col(value)
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum(v).alias("total"), F.sum(v.cast("double") * v).alias("total_of_squares"), F.min(v).alias("least"), F.max(v).alias("largest"), rounded(F.avg(v)).alias("mean"))


def latest_status(attempts: DataFrame, key: str = "run_key") -> DataFrame:
    """The newest status of each run of a table of attempts (R2)."""
    top = F.max(F.struct("finished_at", "attempt_id", "status"))
    return attempts.groupBy(key).agg(top.alias("_t"), F.count("*").alias("attempts")).select(key, F.col("_t.status").alias("status"), F.col("_t.finished_at").alias("updated_at"), "attempts")


def stale(statuses: DataFrame, now: object, timeout_seconds: int) -> DataFrame:
    """Adds ``stale``: the last sign of life is more than the timeout before ``now``."""
    return statuses.withColumn("stale", F.lit(now).cast("timestamp_ntz") - F.col("updated_at") > F.make_dt_interval(secs=F.lit(timeout_seconds)))


class LastAttempt(StatefulProcessor):
    """One row of state a run: its newest attempt and how many there were. A timer marks a run that stays silent."""

    def __init__(self, attempt_type: str, timeout_ms: int) -> None:
        self.state_schema = f"at long, attempt {attempt_type}, status string, attempts long"
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state_schema)

    def _expiry(self, at: int | None) -> int | None:
        return None if at is None else at // 1000 + self.timeout_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = tuple(self.last.get()) if self.last.exists() else (None, None, None, 0)
        order = lambda t: tuple((x is not None, x) if x is not None else (False,) for x in t)  # noqa: E731  nulls first
        top, count = known[:3], known[3]
        for r in rows:
            top, count = max(top, (r["at"], r["attempt_id"], r["status"]), key=order), count + 1
        self.last.update((*top, count))
        old, new = self._expiry(known[0]), self._expiry(top[0])
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None:  # also where it ran out before: late news do not wake a run
            self.handle.registerTimer(new)
        yield Row(run_key=key[0], status=top[2], at=top[0], attempts=count, stale=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, _, status, attempts = self.last.get()
        if self._expiry(at) == expiredTimerInfo.getExpiryTimeInMs():
            yield Row(run_key=key[0], status=status, at=at, attempts=attempts, stale=True)

    def close(self) -> None:
        pass


def stream_attempt_status(
    spark: SparkSession, path: str, schema: StructType, target: str, checkpoint: str, attempts: object, files_per_batch: int = 100, timeout_seconds: int = 86400, once: bool = True
) -> StreamingQuery:
    """Write the changes of each run's newest status, and the flags of runs that fell silent, to ``target`` (R2).

    ``attempts``: maps the stream's rows to ``run_key, attempt_id, status, finished_at`` (times in the session's zone). The state is a row a run in RocksDB.
    Each batch writes, in a folder of its number, one row of each run that it brings news of, and one with ``stale`` of each whose timer ran
    out: ``timeout_seconds`` after its last attempt by the clock. A late attempt is counted, but does not replace a newer one. ``once``: end when all files are read;
    else go on, also without files, so timers run out in time. :func:`current_status` reads the result.
    """
    rows = attempts(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
    rows = rows.select("run_key", "attempt_id", "status", F.unix_micros(F.col("finished_at").cast("timestamp")).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"run_key {kinds['run_key']}, status string, at long, attempts long, stale boolean"
    changes = rows.groupBy("run_key").transformWithState(LastAttempt(kinds["attempt_id"], 1000 * timeout_seconds), out, "Update", "ProcessingTime")

    def publish(batch: DataFrame, batch_id: int) -> None:
        time: Column = F.timestamp_micros("at").cast("timestamp_ntz")
        batch.select("run_key", "status", time.alias("updated_at"), "attempts", "stale").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower()}
    before = {k: spark.conf.get(k) for k in settings}
    try:  # a query keeps the settings that it starts with
        for k, v in settings.items():
            spark.conf.set(k, v)
        writer = changes.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def current_status(spark: SparkSession, target: str) -> DataFrame:
    """Each run's newest row of :func:`stream_attempt_status`: run_key, status, updated_at, attempts, stale."""
    rows = spark.read.parquet(target)
    last = F.max_by(F.struct("status", "updated_at", "attempts", "stale"), F.struct("batch", "stale"))
    return rows.groupBy("run_key").agg(last.alias("_l")).select("run_key", "_l.*")
