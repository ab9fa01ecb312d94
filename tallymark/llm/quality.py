"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of the target (texts labelled good) and one of the
raw corpus, give each document an importance weight: the ratio of its probabilities under the two, tempered.
Documents are then sampled without replacement in proportion to the weights, by the Gumbel top-k trick: add
Gumbel noise to the log weights and keep the k largest. A document far more likely under the target is almost
surely kept, and one far less likely almost surely goes; in between chance decides at the rate of the weight.

k is given, or the number of good documents to expect: the sum over the corpus of the probabilities that a
logistic fit to the labelled rows assigns to the weights.

Everything but the target model and that fit covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pack_columns, release, table, unpack_columns
from .words import Batch, mix

_U = np.uint64
BUCKETS = 1 << 16
#: Byte classes of tokens: white space 0; letters, digits and non-ASCII 1; other ASCII 2.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[0x20, 9, 10, 11, 12, 13]] = 0
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Tokens per step, which bounds a step's memory whatever a text's length.
STEP_BYTES = 1 << 20


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text)`` of all unigrams and bigrams of tokens; a pair of equal tokens is one n-gram, whatever the token."""
    batch = Batch(texts, CLASSES)
    names = batch.names(3)
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = batch.doc[1:] == batch.doc[:-1]
    with np.errstate(over="ignore"):
        both = np.where(names[1:] == names[:-1], _U(11), mix(names[:-1] * _U(0x9E3779B97F4A7C15) + names[1:]))[pair]
    bucket = np.concatenate((mix(names ^ _U(5)), mix(both ^ _U(6)))) % _U(BUCKETS)
    return bucket.astype(np.int64), np.concatenate((batch.doc, batch.doc[1:][pair]))


def steps(texts: list[str]) -> Iterator[slice]:
    """Ranges of texts of about STEP_BYTES characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def fit(docs: DataFrame, labels: DataFrame, sample: int, prior: float) -> np.ndarray:
    """Log ratio of the target's and the corpus's probability of each bucket.

    ``prior`` counts of the corpus are added to the target's bucket, so that rare n-grams weigh little.
    Without good labels all ratios are 0.
    """
    good = labels.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id")).distinct()
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for s in steps(texts):
                bucket, doc = ngrams([t.encode() for t in texts[s]])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[s][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], names=["bucket", "raw", "target"])

    parts = marked.select("text", F.col("_id").isNotNull().alias("good")).mapInArrow(count, "bucket long, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + prior) / (expected + prior))


def weigh(docs: DataFrame, model: np.ndarray, evidence: float, seed: int) -> DataFrame:
    """Adds ``log_weight`` and ``gumbel_key`` to ``docs(doc_id, text)``.

    The log weight is the sum of the log ratios of the text's n-grams, tempered: n-grams overlap and depend on each other,
    so those beyond ``evidence`` only make the mean more certain, that is, the sum is scaled by ``evidence`` / their number.
    Without that, noise of standard deviation 1.28 would not matter beside a long text's sum. No n-grams: 0.
    The noise is a hash of the doc_id and text, so reruns agree.
    """

    @F.pandas_udf("double")
    def log_weight(column: pd.Series) -> pd.Series:
        texts = [t or "" for t in column]
        out = np.zeros(len(texts))
        for s in steps(texts):
            bucket, doc = ngrams([t.encode() for t in texts[s]])
            n = s.stop - s.start
            total, many = np.bincount(doc, model[bucket], minlength=n), np.bincount(doc, minlength=n)
            out[s] = total * np.minimum(1, evidence / np.maximum(many, 1))
        release()
        return pd.Series(out)

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(1 << 53)
    return docs.withColumn("log_weight", log_weight(F.col("text"))).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def calibrate(weight: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float] | None:
    """``(slope, intercept)`` of the log odds of good by weight: logistic regression by Newton steps, the slope slightly shrunk.

    None where labels of one kind are missing.
    """
    if not len(weight) or good.all() or not good.any():
        return None
    x, at = np.column_stack((weight, np.ones(len(weight)))), np.zeros(2)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0, np.where(good, -z, z)).sum() + 0.005 * at[0] ** 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        slope = x.T @ (p - good) + np.array([0.01 * at[0], 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-6]), slope)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def bar_of(keys: DataFrame, k: int, bins: int = 1024) -> tuple[float, int | None]:
    """``(key, doc_id)`` of the k-th row of ``keys(gumbel_key, doc_id)`` by key down, doc_id up (nulls last).

    Counts in ever narrower ranges, so no task and not the driver holds more than ``bins`` rows of counts.
    """
    lo, hi = keys.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    above, inside = 0, keys
    while lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        cell = F.least(F.lit(bins - 1), F.floor((F.col("gumbel_key") - lo) / width))
        counts = {r["c"]: (r["n"], r["a"], r["b"]) for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b")).collect()}
        for c in sorted(counts, reverse=True):
            n, a, b = counts[c]
            if above + n >= k:
                break
            above += n
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
        inside = keys.filter(F.col("gumbel_key").between(lo, hi))
        if n <= bins:
            break
    last = inside.filter(F.col("gumbel_key").between(lo, hi)).orderBy(F.desc("gumbel_key"), F.asc_nulls_last("doc_id")).limit(k - above).agg(F.max(F.struct(-F.col("gumbel_key"), F.col("doc_id").isNull(), "doc_id")).alias("m")).first()["m"]
    return -last[0], last[2]


def scores(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = 20000, prior: float = 8.0, evidence: float = 16.0, seed: int = 29) -> tuple[DataFrame, np.ndarray, tuple[float, int | None] | None]:
    """``(table, model, bar)``: the narrow table ``doc_id, log_weight, gumbel_key``, the model and the k-th row by key.

    The bar is None where all rows stay. See :func:`classify`.
    """
    known = labels.filter("doc_id is not null and quality is not null")
    model = fit(docs, known, sample, prior)
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    scored = weigh(docs.select("doc_id", "text"), model, evidence, seed).select("doc_id", "log_weight", "gumbel_key")
    scored = cut(scored.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    if k is None:
        pairs = scored.filter("quality is not null").groupBy("doc_id").agg(F.min("log_weight").alias("w"), F.max("quality").alias("q")).orderBy("doc_id").toPandas()  # `sample` rows at most
        line = calibrate(pairs["w"].to_numpy(), pairs["q"].to_numpy() == 1)
        if line is None:
            return scored, model, None
        odds = F.exp(-(F.col("log_weight") * line[0] + line[1]))
        # thousandths add up to the same number in any order
        k = (scored.agg(F.sum(F.round(1000 / (1 + odds)).cast("long"))).first()[0] or 0) // 1000
    if k >= scored.count():
        return scored, model, None
    return scored, model, bar_of(scored, k) if k else (np.inf, None)


def above(bar: tuple[float, int | None] | None) -> Column:
    """Whether a row with ``gumbel_key`` and ``doc_id`` is among those down to the bar."""
    if bar is None:
        return F.lit(True)
    tie = F.lit(True) if bar[1] is None else F.coalesce(F.col("doc_id") <= bar[1], F.lit(False))
    return (F.col("gumbel_key") > float(bar[0])) | ((F.col("gumbel_key") == float(bar[0])) & tie)


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = 20000, prior: float = 8.0, evidence: float = 16.0, seed: int = 29) -> DataFrame:
    """``docs`` with ``log_weight``, ``gumbel_key`` and ``kept``, which replace columns of those names.

    ``k`` rows are kept (None: as many as are expected to be good; rows that tie with the k-th in key and doc_id stay with it).
    ``labels(doc_id, quality)``: at most ``sample`` good ones fit the target model, and as many of all
    labels the logistic line; both are taken in the order of a hash of the doc_id. Without labels of both kinds
    and without ``k`` all rows stay. Null and empty texts have log weight 0. Null labels are ignored, a doc_id labelled twice
    counts as good if one label says so; repeated rows are rows of their own; an empty table gives an empty result.
    """
    _, model, bar = scores(docs, labels, k, sample, prior, evidence, seed)
    return weigh(docs, model, evidence, seed).withColumn("kept", above(bar))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored, _, bar = scores(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("quality").withColumn("kept", above(bar))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the resampling keeps."""
    kept = classify(pack_columns(docs), table(spark, sf_dir, "labels")).filter("kept")
    return unpack_columns(kept, docs.columns)
