"""Toxicity by a classifier chain.

Categories are columns of the labels, predicted one after the other by logistic models over hashed words (presence); each model also gets the earlier categories' probabilities
(as log odds). Later models are trained on out-of-fold probabilities of the earlier ones, never on those of a model that saw the row. CATEGORIES (a parameter) names each category's column and the value
that means it: junk (quality 0) first, then toxic, whose model so knows how junk-like a text is.
Models are fitted on the driver on at most MOST_LABELLED labelled documents, those of the smallest seeded hash; scoring covers all documents in one scan without a shuffle.
A document is flagged if the last category's probability reaches the cutoff with the best F1 among the out-of-fold predictions.

Defined cases: null and empty texts have the models' intercepts as features; labels with a null doc_id are ignored, a null label in a category leaves the row out of that category's fit; several labels of a document are several training rows, of several texts of a
labelled id the smallest is used; rows that repeat are scored each, null ids too; without labels of both classes a category's probability is 0 or 1, as its labels are (0 without labels), and with no cutoff nothing is flagged. Extra columns stay and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, rank_hash, row_ids, sized, word_codes, written

MOST_LABELLED = 20_000
BITS = 18
FOLDS = 3
STEPS = 40
L2 = 2.0
SEED = 5
#: name -> (column of the labels, value)
CATEGORIES: dict[str, tuple[str, int]] = {"junk": ("quality", 0), "toxic": ("toxic", 1)}


def word_buckets(texts: pa.Array, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct words of each row, of those with a weight if given."""
    codes, at = word_codes(texts)
    bucket = (codes >> np.uint64(64 - BITS)).astype(np.int64)
    rows = row_ids(at)
    if weight is not None:
        some = weight[bucket]
        bucket, rows = bucket[some], rows[some]
    both = np.unique((rows << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Linear:
    weights: np.ndarray  #: of the buckets
    earlier: np.ndarray  #: of the earlier categories' log odds
    intercept: float

    def probability(self, n: int, rows: np.ndarray, buckets: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.weights[buckets], n) + earlier @ self.earlier + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(rows: np.ndarray, buckets: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression with an L2 penalty by Adam over all rows and all buckets that occur, each scaled by how surely its share differs between the classes (z^2 / (z^2 + 9))."""
    n, pos = len(y), float(y.sum())
    weights = np.zeros(1 << BITS)
    if pos in (0, n):
        return Linear(weights, np.zeros(earlier.shape[1]), 30.0 if n and pos == n else -30.0)
    used, f = np.unique(buckets, return_inverse=True)
    # both directions as sums over stretches: rows stand together as they come, features after one sort
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    some = rows[at]
    by = np.argsort(f, kind="stable")
    of, at_f = rows[by], np.searchsorted(f[by], np.arange(len(used)))
    df, hit = np.bincount(f, minlength=len(used)), np.bincount(f, y[rows], len(used))
    z2 = (hit - df * pos / n) ** 2 / (df * pos / n * (1 - pos / n) + 0.5)
    scale = z2 / (z2 + 9)
    k = len(used) + earlier.shape[1]
    w, b = np.zeros(k), float(np.log(pos / (n - pos)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, STEPS + 1):
        margin = earlier @ w[len(used) :] + b
        if len(at):
            margin[some] += np.add.reduceat((w[: len(used)] * scale)[f], at)
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        g = np.concatenate([np.add.reduceat(error[of], at_f) * scale if len(used) else np.zeros(0), error @ earlier]) + L2 * 0.5 * w
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - step / (STEPS + 1)) + 0.005
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    weights[used] = w[: len(used)] * scale
    return Linear(weights, w[len(used) :], b)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    cutoff: float

    def probabilities(self, n: int, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack([out, m.probability(n, rows, buckets, odds(out))])
        return out


def fit_chain(n: int, rows: np.ndarray, buckets: np.ndarray, targets: dict[str, np.ndarray], seed: int = SEED, folds: int = FOLDS) -> Chain:
    """targets: 1, 0 or nan (not labelled) of each row by category, in the chain's order."""
    fold = np.random.default_rng(seed).integers(0, folds, n)
    held = np.zeros((n, 0))
    models, cutoff = [], 2.0

    def part(inside: np.ndarray, y: np.ndarray) -> Linear:
        place = np.cumsum(inside) - 1
        some = inside[rows]
        return fit(place[rows[some]], buckets[some], odds(held[inside]), y[inside])

    for y in targets.values():
        known = ~np.isnan(y)
        models.append(part(known, y))
        out = models[-1].probability(n, rows, buckets, odds(held))
        for k in range(folds):
            outside = known & (fold == k)
            if outside.any():
                out[outside] = part(known & (fold != k), y).probability(n, rows, buckets, odds(held))[outside]
        cutoff, total = 2.0, float(y[known].sum())
        if 0 < total < known.sum():
            order = np.flatnonzero(known)[np.argsort(-out[known], kind="stable")]
            right = np.cumsum(y[order])
            f1 = 2 * right / (np.arange(1, len(order) + 1) + total)
            best = int(np.argmax(f1))
            # half way to the next prediction, so that the cutoff doesn't hang on one row
            cutoff = float((out[order[best]] + (out[order[best + 1]] if best + 1 < len(order) else 0)) / 2)
        held = np.column_stack([held, out])
    return Chain(list(targets), models, cutoff)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, tuple[str, int]] | None = None, most: int = MOST_LABELLED, seed: int = SEED) -> Chain:
    categories = categories or CATEGORIES
    names = [f"y{k}" for k in range(len(categories))]
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), *[(F.col(c) == v).cast("int").alias(y) for y, (c, v) in zip(names, categories.values())]).where("id is not null")
    known = written(known.orderBy(rank_hash("id", seed=seed), "id", *names).limit(most), "labelled")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(sized(known.select("id").distinct(), most), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, buckets = word_buckets(b.column(1))
            at = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([buckets[at[i] : at[i + 1]].astype("<i4").tobytes() for i in range(b.num_rows)], pa.binary())], names=["id", "buckets"])

    sets = {r.id: np.frombuffer(r.buckets, "<i4") for r in texts.mapInArrow(featured, "id bigint, buckets binary").collect()}
    rows = sorted((tuple(r) for r in known.collect() if r.id in sets), key=str)
    targets = {c: np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k, c in enumerate(categories, 1)}
    flat = np.concatenate([sets[r[0]] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    return fit_chain(len(rows), np.repeat(np.arange(len(rows)), [len(sets[r[0]]) for r in rows]).astype(np.int64), flat, targets, seed)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, p_<category> for each category in the chain's order, toxic (the flag of the last one), for every row."""
    chain = train(docs, labels, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = "doc_id bigint, " + ", ".join(f"p_{c} double" for c in chain.names) + ", toxic boolean"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        used = np.any([m.weights != 0 for m in c.models], axis=0)
        for b in pieces(batches):
            p = c.probabilities(b.num_rows, *word_buckets(b.column(1), used))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.round(x, 6)) for x in p.T), pa.array(p[:, -1] >= c.cutoff)], names=["doc_id", *(f"p_{n}" for n in c.names), "toxic"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, schema)
