"""Quality by importance resampling.

Two bags of hashed words and word bigrams (BUCKETS buckets) are counted: of the target (documents labelled quality 1) and of the raw text (all documents). A document's weight is the log ratio of
its likelihoods under both generative models, summed over all its n-grams. Gumbel noise, seeded and made from the row's id, is added to it; the k rows with the largest sums are a sample without replacement in proportion to the weights (Gumbel top-k).
k is a share of the rows with text. The k-th largest sum is found by counting in ever finer intervals, so nothing is sorted as a whole.

Defined cases: null and empty texts have weight null and are never selected; labels with a null doc_id or quality are ignored, a document with any label of quality 1 is target once;
without target documents the ratio is 0 everywhere and the sample uniform; ties are cut by the smaller hash of id and text, rows equal in all of that are selected together (k is then exceeded by their number less one at most);
repeated rows draw the same noise; null ids draw by their text. Extra columns stay and take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, rolled, row_ids, sized, uniform, word_codes, written

BUCKETS = 10_000
SHARE = 0.5
SMOOTHING = 1.0
SEED = 23
#: Rows of the last interval that the driver looks at.
FEW = 50_000


def buckets(texts: pa.Array, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every bigram within a row."""
    codes, at = word_codes(texts)
    rows = row_ids(at)
    two = rolled(codes, 2)
    inside = rows[1:] == rows[:-1]
    return np.concatenate([rows, rows[1:][inside]]), np.concatenate([(codes >> np.uint64(11)) % np.uint64(size), (two[inside] >> np.uint64(11)) % np.uint64(size)]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for b in pieces(batches):
        rows, x = buckets(b.column(0))
        target = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        total[0] += np.bincount(x, minlength=BUCKETS)
        total[1] += np.bincount(x[target[rows]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["bag", "counts"])


def _summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bag": [key[0]], "counts": [sum(np.frombuffer(x, np.int64) for x in pdf["counts"]).tobytes()]})


def ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not target.any():
        return np.zeros(len(raw))
    share = lambda c: np.log(c + smoothing) - math.log(c.sum() + smoothing * len(c))
    return share(target.astype(float)) - share(raw.astype(float))


def _cut(keys: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th largest (key, tie) of keys(key, tie); None if all are in. Counts in 1024 intervals at a time, then looks at those of the one that holds it."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n:
        return None
    if k <= 0:
        return (math.inf, 0)
    while n > FEW and high > low:
        step = (high - low) / 1024
        part = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(1023)) if step > 0 else F.lit(0)
        counts = keys.where(F.col("key").between(low, high)).groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.p):
            if k <= r.c:
                if (r.low, r.high) == (low, high):
                    n = 0
                low, high, n = r.low, r.high, min(n, r.c)
                break
            k -= r.c
        if n == 0:
            break
    rows = keys.where(F.col("key").between(low, high)).orderBy(F.desc("key"), F.asc("tie")).limit(k)
    last = rows.agg(F.min(F.struct("key", (-F.col("tie")).alias("tie"))).alias("m")).first().m
    return (last.key, -last.tie)


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, selected for every row."""
    spark = docs.sparkSession
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.lit(True).alias("target")).distinct()
    good = written(good, "targets")
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = plain.join(sized(good, good.count()), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    bags = {r.bag: np.frombuffer(r.counts, np.int64) for r in known.mapInArrow(_counted, "bag int, counts binary").groupBy("bag").applyInPandas(_summed, "bag int, counts binary").collect()}
    zero = np.zeros(BUCKETS, np.int64)
    shared = spark.sparkContext.broadcast(ratios(bags.get(0, zero), bags.get(1, zero)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, x = buckets(b.column(3))
            count = np.bincount(rows, minlength=b.num_rows)
            weight = np.bincount(rows, shared.value[x], b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(count.astype(np.int64)), pa.array(weight, mask=count == 0)], names=["doc_id", "noise", "tie", "n_grams", "log_weight"])

    drawn = plain.select(F.col("id").alias("doc_id"), uniform(F.col("id"), F.when(F.col("id").isNull(), F.col("text")), seed=seed).alias("noise"), F.shiftrightunsigned(F.xxhash64("id", "text"), 1).alias("tie"), "text")
    weights = drawn.mapInArrow(weighed, "doc_id bigint, noise double, tie bigint, n_grams bigint, log_weight double")
    keyed = written(weights.withColumn("key", F.col("log_weight") - F.log(-F.log("noise"))).drop("noise"), "importance")
    valid = keyed.where("key is not null")
    cut = _cut(valid.select("key", "tie"), math.floor(share * valid.count()))
    chosen = F.col("key").isNotNull() if cut is None else F.coalesce((F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & (F.col("tie") <= cut[1])), F.lit(False))
    return keyed.select("doc_id", "n_grams", "log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))
