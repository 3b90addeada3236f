"""Benchmark decontamination: documents are scanned for the n-grams of test items.

The items' n-grams of normalised words (lower-cased runs of letters, marks and digits) are hashed. While there are at most
BROADCAST_GRAMS of them, they go to every task and each document's windows are looked up in one scan without a
shuffle. Beyond that a sieve of SIEVE bits, filled from all n-grams and of the same size however many there are, goes to every task, and only windows that pass it are joined, with their words, with the
n-grams themselves. Each hit is verified word for word either way. Hits of a document that overlap or touch merge to spans.

Defined cases: an item of fewer than N words but at least LEAST words is one n-gram of its own length, a shorter one is no
evidence and is ignored; null or empty texts have no hits; an n-gram of several items counts for the smallest item_id; an item with a null item_id counts like any other, its spans have a null item_id unless another item has the n-gram too; rows that
repeat are each reported and cleaned alike; without items or documents the result is empty; a row with a null doc_id is scanned as any other.
Extra columns stay and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, WORD, WORDS_SQL, checkpointed, free_names, lean, pieces, rolled, row_ids, word_codes, words, written

N = 8
LEAST = 5
#: A document goes if spans hold this share of its words or more; otherwise the spans are cut out.
DROP_SHARE = 0.2
#: 8 bytes each and the verified words: about 150 MB at most in a task.
BROADCAST_GRAMS = 1_000_000
#: Bits of the sieve for more (16 MB).
SIEVE = 1 << 27
SPANS = "array<struct<item_id:bigint,first_word:int,last_word:int>>"


def item_grams(benchmark: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """gram (its words, space-separated), n_words, item_id: every distinct n-gram of the items."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, int] = {}
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                for k in range(max(1, len(w) - n + 1) if len(w) >= least else 0):
                    g = " ".join(w[k : k + n])
                    known = found.get(g)
                    found[g] = item if known is None else known if item is None else min(item, known)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(list(found), pa.string()), "n_words": pa.array([g.count(" ") + 1 for g in found], pa.int32()), "item_id": pa.array(list(found.values()), pa.int64())})

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(lean(grams), "gram string, n_words int, item_id bigint").groupBy("gram", "n_words").agg(F.min("item_id").alias("item_id"))


def _merged(hits: list[tuple[int, int, int]]) -> list[dict]:
    """Spans from (first, last, item) hits: those that overlap or touch merge; a span has the item of its first hit."""
    spans: list[list[int]] = []
    for first, last, item in sorted(hits, key=lambda h: (h[0], h[1], h[2] is not None, h[2] or 0)):
        if spans and first <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], last)
        else:
            spans.append([first, last, item])
    return [{"item_id": i, "first_word": a, "last_word": b} for a, b, i in spans]


def _scan(grams: dict[str, int]):
    """Hits of one Arrow batch: (row, spans, words) for the rows that have any."""
    lengths = sorted({g.count(" ") + 1 for g in grams})
    codes, at = word_codes(pa.array(list(grams), pa.string()))
    hashes = {n: [] for n in lengths}
    for k, n in enumerate(np.diff(at)):
        hashes[int(n)].append(rolled(codes[at[k] : at[k + 1]], int(n))[0])
    known = {n: np.unique(np.array(x, np.uint64)) for n, x in hashes.items()}
    #: One bit for each value of a hash's low 22 bits: most windows end here.
    sieve = {n: np.zeros(1 << 22, bool) for n in lengths}
    for n in lengths:
        sieve[n][(known[n] & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def scan(texts: pa.Array) -> Iterator[tuple[int, list[dict], int]]:
        codes, at = word_codes(texts)
        rows = row_ids(at)
        suspects: set[int] = set()
        for n in lengths:
            windows = rolled(codes, n)
            may = np.flatnonzero(sieve[n][(windows & np.uint64((1 << 22) - 1)).astype(np.int64)])
            may = may[np.isin(windows[may], known[n])]
            suspects.update(rows[may[at[rows[may] + 1] - may >= n]].tolist())
        for i in sorted(suspects):
            w = words(texts[i].as_py())
            hits = [(k, k + n - 1, grams[g]) for n in lengths for k in range(len(w) - n + 1) if (g := " ".join(w[k : k + n])) in grams]
            if hits:
                yield i, _merged(hits), len(w)

    return scan


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: int = LEAST, most: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, item_id, first_word, last_word, doc_words: one row for each contaminated span of each document row."""
    spark = docs.sparkSession
    grams = item_grams(benchmark, n, least)
    rows = grams.limit(most + 1).collect()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(rows) > most:
        return _joined_spans(plain, grams)
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, first_word int, last_word int, doc_words int")
    shared = spark.sparkContext.broadcast({r.gram: r.item_id for r in rows})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared.value)
        for b in pieces(batches, size=PIECE):
            ids, out = b.column(0), []
            for i, hit, count in scan(b.column(1)):
                out += [{"doc_id": ids[i].as_py(), **s, "doc_words": count} for s in hit]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("doc_words", pa.int32())]))

    return plain.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(lean(found), "doc_id bigint, item_id bigint, first_word int, last_word int, doc_words int")


def _joined_spans(plain: DataFrame, grams: DataFrame) -> DataFrame:
    """As spans(), by _row_spans()."""
    numbered = checkpointed(plain.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return _row_spans(numbered, grams).select("doc_id", "doc_words", F.explode("spans").alias("s")).select("doc_id", "s.*", "doc_words")


def _gram_hashes(texts: pa.Array) -> np.ndarray:
    """One hash for the words of each row."""
    codes, at = word_codes(texts)
    return np.array([rolled(codes[a:b], int(b - a))[0] for a, b in zip(at[:-1], at[1:])], np.uint64)


def _sieve(grams: DataFrame) -> np.ndarray:
    """The bits of all n-grams: parts of 2^15 bytes, joined over all tasks."""
    size = 1 << 15

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE, bool)
        for b in batches:
            bits[(_gram_hashes(b.column(0)) % np.uint64(SIEVE)).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, size)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(some.astype(np.int32)), "bits": pa.array([pa.compress(packed[k].tobytes(), "zstd", asbytes=True) for k in some], pa.binary())})

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(pa.decompress(x, size, "zstd"), np.uint8)
        return pd.DataFrame({"part": [key[0]], "bits": [total.tobytes()]})

    out = np.zeros(SIEVE // 8, np.uint8)
    for r in grams.select("gram").mapInArrow(lean(parts), "part int, bits binary").groupBy("part").applyInPandas(together, "part int, bits binary").collect():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _row_spans(numbered: DataFrame, grams: DataFrame) -> DataFrame:
    """row, doc_id, doc_words, spans of the rows that have any, from row, doc_id and text, for item sets too large to broadcast: windows that pass the sieve are joined with the grams themselves, so nothing is left to verify."""
    grams = written(grams, "grams")
    lengths = sorted(r.n_words for r in grams.select("n_words").distinct().collect())
    shared = numbered.sparkSession.sparkContext.broadcast(_sieve(grams))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("doc_words", pa.int32()), ("first", pa.int32()), ("gram", pa.string())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in pieces(batches, size=PIECE):
            codes, at = word_codes(b.column(2))
            rows, found = row_ids(at), []
            for n in lengths:
                place = (rolled(codes, n) % np.uint64(SIEVE)).astype(np.int64)
                may = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1)
                may = may[at[rows[may] + 1] - may >= n]
                found.append(np.stack([rows[may], may - at[rows[may]], np.full(len(may), n)], 1))
            found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            found = found[np.argsort(found[:, 0], kind="stable")]
            out = {k: [] for k in schema.names}
            last, w = -1, []
            for i, first, n in found.tolist():
                if i != last:
                    last, w = i, words(b.column(2)[i].as_py())
                for k, v in zip(schema.names, (b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(w), first, " ".join(w[first : first + n]))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    hits = numbered.mapInArrow(lean(windows), "row bigint, doc_id bigint, doc_words int, first int, gram string").join(grams, "gram")
    grouped = hits.groupBy("row", "doc_id", "doc_words").agg(F.collect_set(F.struct("first", (F.col("first") + F.col("n_words") - 1).alias("last"), "item_id")).alias("hits"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_merged([(h["first"], h["last"], h["item_id"]) for h in hs]) for hs in b.column(3).to_pylist()]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(spans, kind)], names=["row", "doc_id", "doc_words", "spans"])

    return grouped.mapInArrow(lean(merged), f"row bigint, doc_id bigint, doc_words int, spans {SPANS}")


def cut_words(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without the words from first to last of each cut, both inclusive, and what stands between those."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, here = [], 0
    for first, last in sorted(cuts):
        kept.append(text[here : at[first][0]])
        here = max(here, at[last][1])
    return "".join([*kept, text[here:]])


def _cleaned(b: pa.RecordBatch, hits: Iterator[tuple[int, list[dict], int]], text_col: str, drop_share: float) -> pa.RecordBatch:
    """b without the rows that go, and with the spans of the others cut out. hits: row, its spans, its words."""
    names = b.schema.names
    at = names.index(text_col)
    keep, new = np.ones(b.num_rows, bool), {}
    for i, hit, count in hits:
        if sum(s["last_word"] - s["first_word"] + 1 for s in hit) >= drop_share * count:
            keep[i] = False
        else:
            new[i] = cut_words(b.column(at)[i].as_py(), [(s["first_word"], s["last_word"]) for s in hit])
    columns = list(b.columns)
    if new:
        texts = columns[at].to_pylist()
        for i, t in new.items():
            texts[i] = t
        columns[at] = pa.array(texts, b.schema.field(at).type)
        if "n_chars" in names:
            k = names.index("n_chars")
            sizes = columns[k].to_pylist()
            for i, t in new.items():
                sizes[i] = len(t)
            columns[k] = pa.array(sizes, b.schema.field(k).type)
    return pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = N, least: int = LEAST, drop_share: float = DROP_SHARE, most: int = BROADCAST_GRAMS) -> DataFrame:
    """docs: rows with drop_share of their words in spans are gone, the spans of the others are cut out. Other columns stay, n_chars follows the text.
    One scan and no shuffle for up to `most` n-grams; beyond that the spans are joined, and joined back to the rows."""
    grams = item_grams(benchmark, n, least)
    rows = grams.limit(most + 1).collect()
    if not rows:
        return docs
    if len(rows) > most:
        # the numbers must be the same on both sides of the join
        at, size, cuts = free_names(docs, "row", "doc_words", "spans")
        numbered = checkpointed(docs.withColumn(at, F.monotonically_increasing_id()))
        hit = _row_spans(numbered.select(F.col(at).alias("row"), F.lit(None).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), grams)
        joined = numbered.join(hit.select(F.col("row").alias(at), F.col("doc_words").alias(size), F.col("spans").alias(cuts)), at, "left")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans, count = b.column(b.num_columns - 1), b.column(b.num_columns - 2)
                hits = ((int(i), spans[int(i)].as_py(), count[int(i)].as_py()) for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)))
                yield _cleaned(b.select(range(b.num_columns - 2)), hits, text_col, drop_share)

        return joined.select(*docs.columns, size, cuts).mapInArrow(lean(cut), docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast({r.gram: r.item_id for r in rows})

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared.value)
        for b in pieces(batches, size=PIECE):
            yield _cleaned(b, scan(b.column(b.schema.names.index(text_col))), text_col, drop_share)

    return docs.mapInArrow(lean(cleaned), docs.schema)


ORACLE = f"""
WITH iw AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
gs AS (SELECT array_to_string(w[k:k + {N} - 1], ' ') AS gram, min(item_id) AS item_id
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {N} + 1) + 1)) AS k FROM iw WHERE len(w) >= {LEAST}) GROUP BY ALL),
grams AS (SELECT gram, item_id, len(string_split(gram, ' ')) AS n FROM gs),
dw AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
windows AS (SELECT r, doc_id, len(w) AS doc_words, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
            FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM grams))),
hits AS (SELECT r, doc_id, doc_words, k - 1 AS first, k + grams.n - 2 AS last, item_id FROM windows JOIN grams USING (gram)),
marked AS (SELECT *, coalesce(first > max(last) OVER (PARTITION BY r ORDER BY first, last, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS opens FROM hits),
numbered AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY first, last, item_id ROWS UNBOUNDED PRECEDING) AS span FROM marked)
SELECT doc_id, arg_min(item_id, first * 1000000000 + last) AS item_id, CAST(min(first) AS INT) AS first_word, CAST(max(last) AS INT) AS last_word, CAST(any_value(doc_words) AS INT) AS doc_words
FROM numbered GROUP BY r, doc_id, span"""
