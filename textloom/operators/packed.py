"""Sums over pairs of strings (x, y) by one packed shuffle: each task sums what it holds, and for each bucket of x sends one compressed part instead of a row for each pair.

A part has the different x in order, how many y each has, the y, and columns of whole numbers, each in the narrowest width. Parts of a bucket meet in one task, which sums them bucket by bucket, so that it holds one bucket's different pairs besides
HELD more. All rows of an x come from one task one after the other. Strings are compared whole: hashes only choose the bucket. Strings stay bytes and are never decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PARTS = "bucket int, part binary"
BUCKETS = 1024
#: Pairs that a task holds before it sums and sends them.
HELD = 1 << 21
#: Bytes of text whose words are found at once; rows and bytes that go back to the JVM at once.
TEXT, ROWS = 1 << 23, 1 << 15

Batches = Iterator[pa.RecordBatch]
Columns = list[np.ndarray]


def strings(lengths: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of strings; null ones are empty."""
    a = a.cast(pa.large_string())
    if a.null_count:
        a = pc.fill_null(a, "")
    if not len(a):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, at, data = a.buffers()
    offsets = np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1]
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)


_GAP = np.zeros(256, bool)
_GAP[list(b" \n\t\r\f")] = True


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (runs without the white space of stats.WORD), and each one's row."""
    offsets, data = raw(texts)
    inside = ~_GAP[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    begin = np.flatnonzero(starts)
    at = np.cumsum(inside, dtype=np.int64)[begin] - 1
    kept = data[inside]
    return strings(np.diff(at, append=len(kept)), kept), np.searchsorted(offsets, begin, "right") - 1


def slices(texts: pa.Array, most: int = TEXT) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most so many bytes, or one row."""
    offsets, begin = raw(texts)[0], 0
    while begin < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1, begin + 1)
        yield begin, end
        begin = end


def bucket_of(a: pa.Array) -> np.ndarray:
    """The bucket of each string; the same in every process."""
    offsets, data = raw(a)
    size = np.diff(offsets)
    powers = np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(offsets[:-1], size)], out=sums[1:])
    h = sums[offsets[1:]] - sums[offsets[:-1]]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int16)


def coded(a: pa.Array, ordered: bool = False) -> tuple[np.ndarray, pa.Array]:
    """The number of each string among the different ones, and these, in order of their bytes if so wanted."""
    e = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).dictionary_encode()
    code, kinds = e.indices.to_numpy(zero_copy_only=False), e.dictionary
    if not ordered:
        return code, kinds
    order = pc.sort_indices(kinds)
    rank = np.empty(len(kinds), np.int32)
    rank[order.to_numpy()] = np.arange(len(kinds), dtype=np.int32)
    return rank[code], kinds.take(order)


def summed(x: np.ndarray, y: np.ndarray, many: int, columns: Columns) -> tuple[np.ndarray, np.ndarray, Columns]:
    """The different pairs of numbers (y below many) in order, and their sums."""
    key = x.astype(np.int64) * many + y
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] // many, key[at] % many, [np.add.reduceat(c[order], at) if len(at) else c for c in columns]


_CODEC = "zstd"
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _narrow(a: np.ndarray) -> tuple[int, bytes]:
    top = int(a.max(initial=0))
    k = next(k for k, w in enumerate(_WIDTHS) if top <= np.iinfo(w).max)
    return k, a.astype(_WIDTHS[k]).tobytes()


def parts(x: np.ndarray, xs: pa.Array, y: np.ndarray, ys: pa.Array, columns: Columns) -> Batches:
    """Batches of (bucket, part) of different pairs of numbers in order of x, which stand for strings in xs and ys."""
    if not len(x):
        return
    codec = pa.Codec(_CODEC, 1)
    bucket = bucket_of(xs)[x]
    order = np.argsort(bucket, kind="stable")
    x, bucket, columns = x[order], bucket[order], [c[order] for c in columns]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    x_at, x_data = raw(xs.take(pa.array(x[first])))
    y_at, y_data = raw(ys.take(pa.array(y[order])))
    fan, x_size, y_size = np.diff(first, append=len(x)), np.diff(x_at), np.diff(y_at)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    groups = np.searchsorted(first, cuts)
    ends, group_ends = np.append(cuts[1:], len(x)), np.append(groups[1:], len(first))
    out, names, held = [], [], 0
    for a, b, g, h in zip(cuts, ends, groups, group_ends):
        fields = [_narrow(v) for v in (fan[g:h], x_size[g:h], y_size[a:b], *(c[a:b] for c in columns))]
        plain = b"".join((np.array([h - g, b - a, len(columns), *(k for k, _ in fields)], np.int64).tobytes(), *(f for _, f in fields), x_data[x_at[g] : x_at[h]].tobytes(), y_data[y_at[a] : y_at[b]].tobytes()))
        part = len(plain).to_bytes(8, "little") + codec.compress(plain, asbytes=True)
        out.append(part)
        names.append(int(bucket[a]))
        held += len(part)
        if held > TEXT:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "part"])
            out, names, held = [], [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "part"])


def unpacked(part: bytes) -> tuple[pa.Array, np.ndarray, pa.Array, Columns]:
    """The different x, how many rows each has, the y and the columns of a part."""
    plain = pa.Codec(_CODEC).decompress(part[8:], int.from_bytes(part[:8], "little"))
    nx, ny, n = np.frombuffer(plain, np.int64, 3)
    widths, at, fields = np.frombuffer(plain, np.int64, n + 3, 24), 24 + 8 * (int(n) + 3), []
    for k, w in enumerate(widths):
        size = int(ny if k > 1 else nx)
        fields.append(np.frombuffer(plain, _WIDTHS[w], size, at).astype(np.int64))
        at += size * np.dtype(_WIDTHS[w]).itemsize
    fan, x_size, y_size, *columns = fields
    middle = at + int(x_size.sum())
    data = np.frombuffer(plain, np.uint8)
    return strings(x_size, data[at:middle]), fan, strings(y_size, data[middle:]), columns


def _joined(held: list[tuple[pa.Array, np.ndarray, pa.Array, Columns]]) -> tuple[pa.Array, np.ndarray, pa.Array, Columns]:
    """Parts as one, each pair once."""
    xc, xs = coded(pa.concat_arrays([p[0] for p in held]))
    yc, ys = coded(pa.concat_arrays([p[2] for p in held]))
    x, y, columns = summed(np.repeat(xc, np.concatenate([p[1] for p in held])), yc, len(ys), [np.concatenate(c) for c in zip(*(p[3] for p in held))])
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return xs.take(pa.array(x[first])), np.diff(first, append=len(x)), ys.take(pa.array(y)), columns


def merged(df: DataFrame, names: list[str], finish: Callable[[np.ndarray, np.ndarray, Columns], tuple[np.ndarray | None, Columns]] | None = None, kinds: str = "bigint") -> DataFrame:
    """Of rows (bucket, part): x, y and the sums of the columns, which names calls (x, y, ...). finish(fan, x of each row, columns) may leave rows out (a mask) and make other columns."""

    def run(batches: Batches) -> Batches:
        def close(held: list) -> Batches:
            xs, fan, ys, columns = _joined(held)
            x = np.repeat(np.arange(len(fan)), fan)
            if finish:
                mask, columns = finish(fan, x, columns)
                if mask is not None:
                    x, ys, columns = x[mask], ys.filter(pa.array(mask)), [c[mask] for c in columns]
            for a in range(0, len(x), ROWS):
                yield pa.RecordBatch.from_arrays([xs.take(pa.array(x[a : a + ROWS])).cast(pa.string()), ys[a : a + ROWS].cast(pa.string()), *(pa.array(c[a : a + ROWS], pa.int64()) for c in columns)], names=names)

        now, held, rows, limit = None, [], 0, HELD
        for b in batches:
            for bucket, part in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now and held:
                    yield from close(held)
                    held, rows, limit = [], 0, HELD
                now = bucket
                held.append(unpacked(part.as_buffer().to_pybytes()))
                rows += len(held[-1][2])
                if rows > limit:  # a bucket of many parts is summed as it comes
                    held = [_joined(held)]
                    rows = len(held[0][2])
                    limit = rows + HELD
        if held:
            yield from close(held)

    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{names[0]} string, {names[1]} string, " + ", ".join(f"{n} {kinds}" for n in names[2:]))


def row_parts(df: DataFrame, x: str, y: str, columns: list[str]) -> DataFrame:
    """(bucket, part) of rows that have a pair and whole numbers from 0."""

    def send(held: list[pa.RecordBatch]) -> Batches:
        t = pa.Table.from_batches(held)
        (xc, xs), (yc, ys) = (coded(pa.concat_arrays([c.cast(pa.large_string()) for c in t.column(k).chunks]), True) for k in (0, 1))
        a, b, sums = summed(xc, yc, len(ys), [t.column(k).to_numpy() for k in range(2, t.num_columns)])
        yield from parts(a, xs, b, ys, sums)

    def run(batches: Batches) -> Batches:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= HELD:
                yield from send(held)
                held, rows = [], 0
        if held:
            yield from send(held)

    return df.select(x, y, *columns).where(f"{x} IS NOT NULL AND {y} IS NOT NULL").mapInArrow(run, PARTS)


def text_parts(df: DataFrame) -> DataFrame:
    """(bucket, part) of pairs of words next to each other in df's second column, with their number and that of rows that have them and whose first column isn't null."""

    def send(held: list[tuple[pa.Array, np.ndarray]], known: list[np.ndarray]) -> Batches:
        row, is_known = np.concatenate([r for _, r in held]), np.concatenate(known)
        code, kinds = coded(pa.concat_arrays([w for w, _ in held]), True)
        inside = np.flatnonzero(row[:-1] == row[1:])
        key = code[inside].astype(np.int64) * len(kinds) + code[inside + 1]
        order = np.argsort(key, kind="stable")  # rows of a pair stay in order
        key, row = key[order], row[inside][order]
        new = np.diff(key, prepend=-1) != 0
        at = np.flatnonzero(new)
        once = ((new | (np.diff(row, prepend=-1) != 0)) & is_known[row]).astype(np.int64)
        yield from parts(key[at] // len(kinds), kinds, key[at] % len(kinds), kinds, [np.diff(at, append=len(key)), np.add.reduceat(once, at) if len(at) else once])

    def run(batches: Batches) -> Batches:
        held, known, rows, size = [], [], 0, 0
        for b in batches:
            for a, z in slices(b.column(1)):
                w, row = words(b.column(1)[a:z])
                held.append((w, (row + rows).astype(np.int32)))
                known.append(pc.is_valid(b.column(0)[a:z]).to_numpy(zero_copy_only=False))
                rows += z - a
                size += len(w)
                if size >= HELD:
                    yield from send(held, known)
                    held, known, rows, size = [], [], 0, 0
        if size:
            yield from send(held, known)

    return df.mapInArrow(run, PARTS)


def turned(df: DataFrame, context: Callable[[np.ndarray, np.ndarray], Columns]) -> DataFrame:
    """(bucket, part) by y of rows (x, y, n) of which those of an x follow one another: (y, x) with n and the columns that context(n, where each x begins) gives, one number for each x."""

    def send(t: pa.Table) -> Batches:
        xc, xs = coded(t.column(0).cast(pa.large_string()))
        yc, ys = coded(t.column(1).cast(pa.large_string()), True)
        n = t.column(2).to_numpy()
        first = np.flatnonzero(np.diff(xc, prepend=-1))
        fan = np.diff(first, append=len(xc))
        y, x, columns = summed(yc, xc, len(xs), [n, *(np.repeat(c, fan) for c in context(n, first))])
        yield from parts(y, ys, x, xs, columns)

    def run(batches: Batches) -> Batches:
        held, rows, limit = [], 0, HELD
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                t = pa.Table.from_batches(held)
                other = np.flatnonzero(~pc.equal(t.column(0), t.column(0)[-1]).to_numpy())
                end = int(other[-1]) + 1 if len(other) else 0  # more rows of the last x may follow
                if end:
                    yield from send(t[:end])
                held = t[end:].to_batches()
                rows -= end
                limit = rows + HELD
        if held:
            yield from send(pa.Table.from_batches(held))

    return df.select("x", "y", "n").mapInArrow(run, PARTS)
