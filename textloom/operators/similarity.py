"""Cosine similarity between vectors: a stated query set against all rows, in blocks.

Queries are broadcast in blocks of at most BLOCK vectors (their bytes are bounded by that); each task multiplies its rows with the block, keeps the best `top` of each query, and a window over these few
rows gives the answer. Vectors are arrays of numbers; null vectors, zero vectors and vectors of another length than the queries' have no similarity and are in no result. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4_096


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Of two array columns; null for null or zero vectors."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((norm > 0) & (F.size(x) == F.size(y)), dot(x, y) / norm)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors of `size` numbers, and them scaled to length 1."""
    kept, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == size and all(x is not None for x in v):
            kept.append(i)
            rows.append(v)
    x = np.array(rows, np.float64).reshape(len(rows), size)
    norm = np.linalg.norm(x, axis=1)
    some = norm > 0
    return np.array(kept, np.int64)[some], x[some] / norm[some, None]


def most_similar(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, top: int = 10) -> DataFrame:
    """query_id, rank, id, similarity: the `top` most similar rows of each row of queries, itself left out."""
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    parts = max(1, -(-asked.count() // BLOCK))
    found = None
    for k in range(parts):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).collect()
        size = len(block[0].v) if block else 0
        which, matrix = _matrix(pa.array([list(r.v) for r in block]) if block else pa.array([], pa.list_(pa.float64())), size)
        shared = spark.sparkContext.broadcast(([block[i].id for i in which], matrix, size))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, size = shared.value
            held: dict[int, list[tuple[float, int]]] = {i: [] for i in ids}
            for b in batches:
                kept, x = _matrix(b.column(1), size)
                own = b.column(0).to_pylist()
                if not len(kept) or not ids:
                    continue
                s = q @ x.T
                for i, row in zip(ids, s):
                    near = np.argpartition(-row, min(top + 1, len(row)) - 1)[: top + 1]
                    edge = row[near].min()
                    near = np.flatnonzero(row >= edge)
                    held[i] = sorted(held[i] + [(-float(row[k]), own[kept[k]]) for k in near if own[kept[k]] is not None and own[kept[k]] != i])[:top]
            out = [(i, j, -s) for i, x in held.items() for s, j in x]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "similarity"])

        part = plain.mapInArrow(best, "query_id bigint, id bigint, similarity double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "id", "similarity")


def predicted(contexts: DataFrame, words: DataFrame, id_col: str, vector_col: str, bias_col: str | None = None, top: int = 10, background: float = 0.0) -> DataFrame:
    """context_id, rank, id, score: for each of a few contexts (broadcast) the words with the largest dot product plus bias, less `background` times the mean over all contexts' scores of that word."""
    c = contexts.select(F.col(id_col).alias("context_id"), F.col(vector_col).alias("cv"))
    w = words.select(F.col(id_col).alias("id"), F.col(vector_col).alias("wv"), (F.col(bias_col) if bias_col else F.lit(0.0)).alias("bias"))
    all_contexts = c.agg(F.collect_list(F.struct("context_id", "cv")).alias("cs"))
    each = w.crossJoin(F.broadcast(all_contexts)).select("id", F.transform("cs", lambda x: F.struct(x.context_id.alias("context_id"), (dot(x.cv, F.col("wv")) + F.col("bias")).alias("s"))).alias("cs"))
    mean = F.aggregate("cs", F.lit(0.0), lambda a, x: a + x.s) / F.size("cs")
    scores = each.withColumn("mean", mean).select("id", "mean", F.explode("cs").alias("c")).select("c.context_id", "id", (F.col("c.s") - F.lit(background) * F.col("mean")).alias("score"))
    order = Window.partitionBy("context_id").orderBy(F.desc("score"), F.asc("id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("context_id", "rank", "id", "score")
