"""Shared helpers: reading, shared-folder tables, size-checked joins, word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, shared_dir  # noqa: F401

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same in DuckDB.
WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+')"
#: Bytes up to which one side of a join is broadcast; more are shuffled.
BROADCAST_BYTES = 64 << 20
#: What a broadcast row of a few numbers takes in a hash table, arrays and strings apart.
ROW_BYTES = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. One that is read in fewer splits than there are cores is spread over them first: such a table is small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, width: float = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted rows, each with `width` bytes of arrays and strings, are within limit bytes, otherwise as it is."""
    return F.broadcast(df) if rows * (ROW_BYTES + width) <= limit else df


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _malloc(name: str, *args: int) -> None:
    """A call of the C library's allocator, where it has it."""
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError, TypeError):
        pass


def settle() -> None:
    """Gives freed memory back to the system, and makes arrays of 1 MB or more be given back as soon as they are freed. Python workers outlive their tasks, and what they hold is the executor's."""
    pa.default_memory_pool().release_unused()
    _malloc("mallopt", -3, 1 << 20)  # M_MMAP_THRESHOLD: else it follows the largest array freed, up to 32 MB
    _malloc("malloc_trim", 0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with settle() before and after it."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        yield from run(batches)
        settle()

    return settled


def free_names(df: DataFrame | list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores behind it as no column of df (compared without case) has."""
    taken, out = {c.lower() for c in (df if isinstance(df, list) else df.columns)}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def rank_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A seeded order of rows that depends on the values only."""
    return F.xxhash64(F.lit(seed), *cols)


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A seeded number in (0, 1) for each row: 52 bits of its hash."""
    return (F.shiftrightunsigned(rank_hash(*cols, seed=seed), 12).cast("double") + 0.5) / float(2**52)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, marks and digits: the words of every operator here, spelt out."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: Bytes of text that are hashed at once, so that the arrays stay in the processor's cache.
_SLICE = 1 << 19
#: Bytes of text whose words are held at once by tasks that hold much besides: arrays over them are some MB each.
PIECE = 1 << 21
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_RADIX, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def _codes(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
        data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
        return data[at[0] : at[-1]], at - at[0]

    low = pc.utf8_lower(rows)
    data, at = raw(low)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(rows) + 1, np.int64)
    lead = np.bincount(data, minlength=256)
    if lead[0xC2] or lead[0xC6:].any() or (lead[0xC3] and (lead[0x97] or lead[0xB7])):
        data, at = raw(pc.replace_substring_regex(low, r"[^\x00-\x7F\p{L}\p{M}\p{N}]", " "))
        n = len(data)
    is_word = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    first = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    last = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    codes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return codes, np.searchsorted(first, at)


def word_codes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and where each row's begin: row i has codes[at[i]:at[i + 1]]. Words as
    in words(). Null is empty. Nothing runs per word: a polynomial over all bytes is summed once, and a word is a difference of two sums."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out, ats, k = [], [np.zeros(1, np.int64)], 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + _SLICE)))
        codes, at = _codes(texts.slice(k, end - k))
        out.append(codes)
        ats.append(at[1:] + ats[-1][-1])
        k = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(ats)


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of codes[i:i + n] for each i, regardless of rows."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(_RADIX)
        out += codes[k : len(codes) - n + 1 + k]
    return mix(out)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of first[1] and so on."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def gram_codes(codes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of each row and where they begin. A row of 1 to n - 1 words has one n-gram of all of them, an empty row none."""
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    where = np.concatenate([[0], np.cumsum(grams)])
    out = np.empty(int(where[-1]), np.uint64)
    full = count >= n
    all_grams = rolled(codes, n)
    into = ranges(where[:-1][full], grams[full])
    out[into] = all_grams[ranges(at[:-1][full], grams[full])]
    for i in np.flatnonzero((count > 0) & ~full):
        out[where[i]] = rolled(codes[at[i] : at[i + 1]], int(count[i]))[0]
    return out, where


def row_ids(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1_500, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows: arrays over the words of thousands of documents at once would need hundreds of MB. With size, slices of more rows than one have at most so many bytes in their strings."""
    for b in batches:
        held = np.zeros(b.num_rows + 1, np.int64)
        for c in b.columns if size else ():
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
                held[1:] += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < b.num_rows:
            end = min(k + rows, b.num_rows)
            if size:
                end = min(end, max(k + 1, int(np.searchsorted(held, held[k] + size, side="right")) - 1))
            yield b.slice(k, end - k)
            k = end
