from __future__ import annotations

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallymark.sources import sinks
from tallymark.streaming import runs as streams

RUNS = "run_key int, committed boolean, cell string, v double"
ATTEMPTS = "run_key string, attempt_id long, status string, finished_at timestamp_ntz"


def made(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, i % 3 > 0, rnd.choice(["a", "b", None]), rnd.choice([None, 1e9 + rnd.random(), rnd.random()])) for i in range(n)]


def plain_cells(rows):
    out = {}
    for _, committed, cell, v in {r[0]: r for r in rows}.values():
        if committed:
            out.setdefault(cell, []).append(v)
    stat = {}
    for cell, values in out.items():
        x = [v for v in values if v is not None]
        stat[cell] = (len(x), statistics.fmean(x) if x else None, statistics.stdev(x) if len(x) > 1 else None, min(x, default=None), max(x, default=None))
    return stat


def same_cells(found, rows):
    got, want = {r.cell: tuple(r)[1:] for r in found}, plain_cells(rows)
    assert set(got) == set(want)
    for cell in want:
        assert got[cell][0] == want[cell][0] and got[cell][3:] == want[cell][3:]
        assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(got[cell][1:3], want[cell][1:3], strict=True))


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("snapshot", [50, 2])
def test_running_statistics_equal_those_of_the_table(spark, tmp_path, monkeypatch, snapshot):
    monkeypatch.setattr(streams, "SNAPSHOT", snapshot)
    rows, cells = made(), streams.Cells(f"{tmp_path}/cells", ["cell"], "v")
    for k in range(3):
        for part in (rows[k * 100 : k * 100 + 60], rows[max(0, k * 100 - 50) : k * 100 + 100]):  # much comes twice
            deliver(spark, f"{tmp_path}/in", part)
        streams.stream_committed_runs(spark, f"{tmp_path}/in", spark.createDataFrame([], RUNS).schema, f"{tmp_path}/out", f"{tmp_path}/cp", files_per_batch=1, cells=cells).awaitTermination()
        same_cells(streams.read_cells(spark, cells).collect(), rows[: k * 100 + 100])
    assert spark.read.parquet(f"{tmp_path}/out").count() == sum(r[1] for r in rows)


@pytest.mark.parametrize("where", ["runs", "statistics", "after"])
def test_a_crash_between_write_and_commit_adds_nothing(spark, tmp_path, monkeypatch, where):
    rows, cells = made(), streams.Cells(f"{tmp_path}/cells", ["cell"], "v")
    for k in range(3):
        deliver(spark, f"{tmp_path}/in", rows[k * 100 : k * 100 + 100])
    start = lambda: streams.stream_committed_runs(spark, f"{tmp_path}/in", spark.createDataFrame([], RUNS).schema, f"{tmp_path}/out", f"{tmp_path}/cp", files_per_batch=1, cells=cells)
    keep = streams.keep_moments

    def failing(batch, cells, batch_id):
        if where == "after" or batch_id != 1:
            keep(batch, cells, batch_id)
        if batch_id == 1:
            if where == "statistics":  # a part of the version is there, but not all
                keep(batch.limit(3), cells, batch_id)
                (tmp_path / "cells/version=1/_SUCCESS").unlink()
            raise RuntimeError("the driver dies")

    monkeypatch.setattr(streams, "keep_moments", failing)
    with pytest.raises(Exception, match="the driver dies"):
        start().awaitTermination()
    same_cells(streams.read_cells(spark, cells).collect(), rows[: 200 if where == "after" else 100])
    monkeypatch.setattr(streams, "keep_moments", keep)
    start().awaitTermination()
    same_cells(streams.read_cells(spark, cells).collect(), rows)
    assert sorted(r.run_key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [r[0] for r in rows if r[1]]


def test_moments_merge_in_any_order(spark):
    rows = made(200, 2)
    parts = [spark.createDataFrame(rows[a:b], RUNS) for a, b in ((0, 1), (1, 50), (50, 51), (51, 200))]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        total = streams.moments(parts[order[0]], ["cell"], "v")
        for k in order[1:]:
            total = streams.merged(total, streams.moments(parts[k], ["cell"], "v"), ["cell"], "full_outer")
        want = plain_cells([(i, True, c, v) for i, _, c, v in rows])
        assert {r.cell: r.n for r in total.collect()} == {c: w[0] for c, w in want.items()}
        assert all(math.isclose(math.sqrt(r.m2 / (r.n - 1)), want[r.cell][2], rel_tol=1e-9) for r in total.collect())


def test_statuses_change_by_batch_and_fall_silent(spark, tmp_path):
    now, day = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), datetime.timedelta(days=1)
    batches = [
        [("old", 1, "started", now - 9 * day), ("old", 2, "done", now - 8 * day), ("live", 5, "started", now + day), ("none", 7, "queued", None)],
        [("old", 3, "late", now - 20 * day), ("new", 1, "started", now - 3 * day)],
        [("new", 2, "running", now + day), ("new", 2, "running", now + day), ("none", 8, "a", None)],
    ]
    target = f"{tmp_path}/out"
    for rows in batches:
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.stream_attempt_status(spark, f"{tmp_path}/in", spark.createDataFrame([], ATTEMPTS).schema, target, f"{tmp_path}/cp", lambda df: df, timeout_seconds=3600).awaitTermination()
    got = {r.run_key: (r.status, r.updated_at, r.attempts, r.stale) for r in streams.current_status(spark, target).collect()}
    assert got == {"old": ("done", now - 8 * day, 3, True), "live": ("started", now + day, 1, False), "none": ("a", None, 2, False), "new": ("running", now + day, 3, False)}
    by_batch = sorted((r.batch, r.run_key, r.stale) for r in spark.read.parquet(target).collect())
    assert by_batch == [
        (0, "live", False), (0, "none", False), (0, "old", False), (0, "old", True), (1, "new", False), (1, "new", True), (1, "old", False), (1, "old", True), (2, "new", False), (2, "none", False)]
    everything = spark.createDataFrame(sum(batches, []), ATTEMPTS)
    assert {(r.run_key, r.status, r.attempts) for r in streams.latest_status(everything).collect()} == {(k, v[0], v[2]) for k, v in got.items()}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(sinks.EvidenceError):
        sinks.shared_folder(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert "/x-" in sinks.shared_folder(Session, "x")
