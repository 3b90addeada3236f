"""Unbounded n-gram scoring with hashed counts of short n-grams and suffix arrays of the stretches that queries share.

Queries go in blocks of about BLOCK_WORDS words. The corpus is scanned once:

1. Its n-grams of up to SHORT words that a sieve of the queries' n-grams lets through are counted by 64-bit hash, added up in each task and then over all, and joined with the blocks that have them.
2. A longer match lies in a run: a stretch in which every n-gram of SHORT + 1 words passes the queries' sieve. Runs that repeat are one run with its count; those of query rows keep their row's key. A join by the hashes
   of these n-grams cuts each run to the stretches that a block has, so what a block gets follows its own words and what the corpus shares with them, not the corpus.
3. One task scores a block: a suffix array of its runs (several, one after the other, beyond SHARD_WORDS words) gives each query position's longest match by binary search; a match that one suffix interval shares is followed at once by word
   hashes, so a long copy costs a few searches, not one for each word. From these follows the longest context of each word, whatever its length; contexts of more than SHORT words, and these with their word, are counted there too.

With c(.) the exact corpus counts, w a word, v the word before it and h its longest context (the longest run of words before it that the corpus has),

    P_0(w) = (c(w) + MU / V) / (N + MU),   P_1(w) = (c(v w) + MU * P_0(w)) / (c(v) + MU),   P(w) = (c(h w) + MU * P_1(w)) / (c(h) + MU)

where a level whose context the corpus lacks is left out; N is the corpus' words and V = N + 1 a bound on its vocabulary. As an operator the queries are the rows whose id is divisible by EVERY, and
all rows are the corpus; what a query's own row (and rows that repeat it, with its id and text) holds is left out of its counts and contexts.

The sieves only say what is worth sending: what passes them wrongly finds no partner. They have 16 bits or more for each word of the queries, up to SIEVE_BITS. Nothing but them passes through the driver.

Defined cases: null and empty queries have no words: null scores, 0 words; null and empty corpus texts hold nothing; matches don't cross documents; an empty corpus gives every word 1 / V;
a row with a null id is no query of every(), but corpus; rows that repeat are scored each; rows with equal id but different texts are different documents and count for each other. Extra columns stay and take no part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, _power, as_signed, discard, lean, mix, pieces, rolled, row_ids, settle, word_codes, written

SHARD_WORDS = 1_250_000
MU = 1.0
#: Words of queries that one task scores.
BLOCK_WORDS = 100_000
EVERY = 100
#: N-grams of up to so many words are counted by hash.
SHORT = 3
#: Bits of the sieves for n-grams of 2, 3, ... SHORT + 1 words at most: 64 MB together.
SIEVE_BITS = {2: 1 << 27, 3: 1 << 27, 4: 1 << 28}
_PART = 1 << 18
#: Different n-grams, and words of runs, that a task adds up before it sends them.
_HELD = 1 << 21
#: Starts that are searched at a time, so that what is held for them stays small.
_STARTS = 1 << 17


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Positions of x in the order of their suffixes. x must end in a number that occurs once."""
    n = len(x)
    order = np.argsort(x, kind="stable").astype(np.int32)
    head = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(head, size)
    slots, h = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32), 1
    while len(slots):
        at = order[slots]
        key = rank[at].astype(np.int64)
        key *= n
        key += rank[np.minimum(at + h, n - 1)]
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        del o
        order[slots] = at
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        del key
        size = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order


def found(table: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands in the ascending table: first place, place behind the last. Equal neighbours are looked up once."""
    new = np.concatenate([[True], want[1:] != want[:-1]])[: len(want)]
    back = np.cumsum(new) - 1
    one = want[new]
    return np.searchsorted(table, one)[back], np.searchsorted(table, one, side="right")[back]


class Run:
    """Words (64-bit hashes) of several documents in a row, each document closed by a mark of its own; hashes of any stretch of them."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray) -> None:
        """ends: the place of each document's mark."""
        self.codes, self.ends = codes, ends
        up, self.down = _power(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.multiply(codes, up[: len(codes)], out=self.total[1:])
        np.cumsum(self.total[1:], out=self.total[1:])

    def hash(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.total[at + length] - self.total[at]) * self.down[at])


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of the documents with a place for each one's mark, and those places."""
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    ends = np.cumsum(sizes) - 1
    codes = np.zeros(int(sizes.sum()), np.uint64)
    for d, e in zip(docs, ends):
        codes[e - len(d) : e] = d
    return codes, ends


def common(x: Run, i: np.ndarray, y: Run, j: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that x from i and y from j share, at most `most`; the first `known` are. Stretches of words are compared by hash, doubling and then halving."""
    low = known.copy()
    most = np.minimum(most, len(y.codes) - j)
    some = np.flatnonzero(low < most)
    some = some[x.codes[i[some] + low[some]] == y.codes[j[some] + low[some]]]
    high, step = most.copy(), 1
    open_ = some
    while len(open_):  # the first stretch that differs
        reach = np.minimum(low[open_] + step, most[open_])
        same = x.hash(i[open_], reach) == y.hash(j[open_], reach)
        high[open_[~same]] = reach[~same]
        low[open_[same]] = reach[same]
        open_ = open_[same & (reach < most[open_])]
        step *= 2
    while len(some := some[low[some] + 1 < high[some]]):
        mid = (low[some] + high[some]) // 2
        same = x.hash(i[some], mid) == y.hash(j[some], mid)
        low[some[same]], high[some[~same]] = mid[same], mid[~same]
    return low


@dataclass
class Shard:
    run: Run
    vocabulary: np.ndarray  #: different word hashes, ascending
    x: np.ndarray  #: of each place the word's number, beyond those of the marks (32 bits)
    order: np.ndarray  #: the suffix array (32 bits)

    def __post_init__(self) -> None:
        self.marks = len(self.run.ends)
        self.k = self.marks + len(self.vocabulary)
        firsts = np.bincount(self.x, minlength=self.k)
        self.at = np.concatenate([[0], np.cumsum(firsts)])
        self.pairs = self._keys(self.x[self.order], 1)

    @cached_property
    def nth(self) -> np.ndarray:
        """The number of each suffix's first two words."""
        return np.cumsum(np.concatenate([[0], self.pairs[1:] != self.pairs[:-1]]), dtype=np.int32)

    @cached_property
    def triples(self) -> np.ndarray:
        return self._keys(self.nth, 2)

    def _keys(self, before: np.ndarray, depth: int) -> np.ndarray:
        """One ascending number for each suffix's words up to depth: that of those before it, and the next word."""
        keys = before.astype(np.int64)
        keys *= self.k
        keys += self.x[np.minimum(self.order + depth, len(self.x) - 1)]
        return keys

    def narrowed(self, q: Run, words: np.ndarray, starts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each start in q the words of its longest prefix, of at most `most`, that the shard has, and that prefix's suffix interval. words: q's words as numbers of this shard, -1 where it lacks them."""
        depth, low, high = np.zeros((3, len(starts)), np.int32)
        on = [np.zeros(0, np.int64)]
        for k in range(0, len(starts), _STARTS):
            depth[k : k + _STARTS], low[k : k + _STARTS], high[k : k + _STARTS], live = self._short(words, starts[k : k + _STARTS], most[k : k + _STARTS])
            on.append(live + k)
        self._long(q, words, starts, most, depth, low, high, np.concatenate(on))
        return depth, low, high

    def _short(self, words: np.ndarray, starts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As narrowed() for prefixes of up to three words, and which starts go on."""
        n = len(starts)
        depth, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((most > 0) & (words[starts] >= 0))
        w = words[starts[live]]
        depth[live], low[live], high[live] = 1, self.at[w], self.at[w + 1]
        live = live[most[live] > 1]
        live = live[words[starts[live] + 1] >= 0]
        want = words[starts[live]] * self.k + words[starts[live] + 1]
        a, b = found(self.pairs, want)
        some = b > a
        live = live[some]
        depth[live], low[live], high[live] = 2, a[some], b[some]
        live = live[most[live] > 2]
        live = live[words[starts[live] + 2] >= 0]
        if len(live):  # most end here: three words are one look-up too
            want = self.nth[low[live]].astype(np.int64) * self.k + words[starts[live] + 2]
            a, b = found(self.triples, want)
            some = b > a
            live = live[some]
            depth[live], low[live], high[live] = 3, a[some], b[some]
            live = live[most[live] > 3]
        return depth, low, high, live

    def _long(self, q: Run, words: np.ndarray, starts: np.ndarray, most: np.ndarray, depth: np.ndarray, low: np.ndarray, high: np.ndarray, live: np.ndarray) -> None:
        """Follows the live starts to their ends, in place."""
        while len(live):
            d, a, b = depth[live].astype(np.int64), low[live].astype(np.int64), high[live].astype(np.int64)
            want = words[starts[live] + d]
            first, last = self.order[a].astype(np.int64), self.order[b - 1].astype(np.int64)
            whole = (self.x[first + d] == want) & (self.x[last + d] == want)
            if whole.any():  # the interval as a whole goes on: to where either end differs
                i = live[whole]
                reach = common(q, starts[i], self.run, first[whole], d[whole], most[i])
                several = np.flatnonzero(b[whole] - a[whole] > 1)
                if len(several):
                    reach[several] = np.minimum(reach[several], common(q, starts[i[several]], self.run, last[whole][several], d[whole][several], most[i[several]]))
                depth[i] = reach
            part = ~whole & (b - a > 1) & (want >= 0)
            if part.any():
                i = live[part]
                bounds = [self._bound(a[part], b[part], d[part], want[part], side) for side in (0, 1)]
                some = bounds[1] > bounds[0]
                i = i[some]
                low[i], high[i] = bounds[0][some], bounds[1][some]
                depth[i] += 1
                part[np.flatnonzero(part)[~some]] = False
            live = live[whole | part]
            live = live[depth[live] < most[live]]

    def _bound(self, a: np.ndarray, b: np.ndarray, d: np.ndarray, want: np.ndarray, side: int) -> np.ndarray:
        """Binary search: the first suffix of each interval whose word at depth d isn't below want (side 0), or is above it (side 1)."""
        a, b, top = a.copy(), b.copy(), len(self.order) - 1
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            here = self.x[self.order[np.minimum(mid, top)] + d[open_]]
            up = here < want[open_] if side == 0 else here <= want[open_]
            a[open_[up]], b[open_[~up]] = mid[up] + 1, mid[~up]
            open_ = open_[a[open_] < b[open_]]
        return a


def indexed(codes: np.ndarray, ends: np.ndarray) -> Shard:
    """The shard of documents as joined() gives them."""
    is_mark = np.zeros(len(codes), bool)
    is_mark[ends] = True
    vocabulary, number = np.unique(codes[~is_mark], return_inverse=True)
    x = np.empty(len(codes), np.int64)
    x[is_mark], x[~is_mark] = np.arange(len(ends)), number + len(ends)
    return opened(x.astype(np.int32), ends, vocabulary, suffix_array(x))


def opened(x: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray, order: np.ndarray) -> Shard:
    marks = mix(np.arange(1, len(ends) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return Shard(Run(np.concatenate([marks, vocabulary])[x], ends), vocabulary, x, order)


def numbers(shard: Shard, codes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """codes[which] as the shard's word numbers, -1 where it lacks them; codes are different and ascending."""
    if not len(shard.vocabulary) or not len(codes):
        return np.full(len(which), -1, np.int64)
    at = np.minimum(np.searchsorted(shard.vocabulary, codes), len(shard.vocabulary) - 1)
    return np.where(shard.vocabulary[at] == codes, at + shard.marks, -1)[which]


def grams(codes: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin n words of one document, and those words' hashes. left: words from each place to its document's end."""
    at = np.flatnonzero(left[: max(0, len(codes) - n + 1)] >= n)
    return at, rolled(codes, n)[at] + np.uint64(n)


def _left(at: np.ndarray) -> np.ndarray:
    return np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a sieve of so many bits (a power of 2)."""
    return (hashes & np.uint64(bits - 1)).astype(np.int64), (hashes >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _probes(hashes, 8 * len(sieve))
    out = (sieve[one >> 3] >> (one & 7).astype(np.uint8) & 1).astype(bool)
    some = np.flatnonzero(out)
    out[some] = sieve[two[some] >> 3] >> (two[some] & 7).astype(np.uint8) & 1
    return out


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a column of codes one after the other, and where each row's begin."""
    docs = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint64), *docs]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def _sieves(coded: DataFrame, total: int) -> dict[int, np.ndarray]:
    """For each n the bits of all n-grams of the queries, joined over all tasks."""
    bits = {n: min(most, max(_PART, 1 << (16 * max(total, 1)).bit_length())) for n, most in SIEVE_BITS.items()}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = _arrays(b.column(0))
            out = {"n": [], "part": [], "bits": []}
            for n, size in bits.items():
                places = np.unique(np.concatenate(_probes(grams(codes, _left(at), n)[1], size)))
                edges = np.searchsorted(places, np.arange(0, size + 1, _PART))
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    here = np.zeros(_PART, bool)
                    here[places[edges[p] : edges[p + 1]] - p * _PART] = True
                    for k, v in (("n", n), ("part", p), ("bits", pa.compress(np.packbits(here, bitorder="little").tobytes(), "zstd", asbytes=True))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("n", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())]))

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_PART // 8, np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(pa.decompress(x, _PART // 8, "zstd"), np.uint8)
        return pd.DataFrame({"n": [key[0]], "part": [key[1]], "bits": [total.tobytes()]})

    kind, out = "n int, part int, bits binary", {n: np.zeros(size // 8, np.uint8) for n, size in bits.items()}
    for r in coded.select("codes").mapInArrow(lean(parts), kind).groupBy("n", "part").applyInPandas(together, kind).collect():
        out[r.n][r.part * _PART // 8 : (r.part + 1) * _PART // 8] = np.frombuffer(r.bits, np.uint8)
    return out


#: Counts have a hash, runs have words (and a key, if they are a query row's); a row with neither has words read.
SCANNED = "hash bigint, key bigint, words binary, c bigint"
_SCANNED = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("words", pa.binary()), ("c", pa.int64())])


def _scanning(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = shared.value
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        runs: dict[tuple, int] = defaultdict(int)
        held = read = 0

        def counted() -> pa.RecordBatch:
            none = pa.nulls(len(hashes), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(as_signed(hashes)), none, pa.nulls(len(hashes), pa.binary()), pa.array(counts)], schema=_SCANNED)

        def shared_runs() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(runs), pa.int64()), pa.array([k for k, _ in runs], pa.int64()), pa.array([w for _, w in runs], pa.binary()), pa.array(list(runs.values()), pa.int64())], schema=_SCANNED)

        for b in pieces(batches, size=PIECE):
            codes, at = word_codes(b.column(1))
            left, keys, found = _left(at), b.column(0).to_pylist(), []
            read += len(codes)
            for n in range(1, SHORT + 1):
                g = grams(codes, left, n)[1]
                found.append(g if n == 1 else g[_passes(sieves[n], g)])
            new, count = np.unique(np.concatenate(found), return_counts=True)
            hashes, back = np.unique(np.concatenate([hashes, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, count]), len(hashes)).astype(np.int64)
            if len(hashes) > _HELD:
                yield counted()
                hashes, counts = hashes[:0], counts[:0]
            starts, g = grams(codes, left, SHORT + 1)
            starts = starts[_passes(sieves[SHORT + 1], g)]
            opens = np.concatenate([[True], np.diff(starts) != 1])[: len(starts)]
            first, last = starts[opens], starts[np.append(opens[1:], True)[: len(starts)]] + SHORT + 1
            for i, a, e in zip((np.searchsorted(at, first, "right") - 1).tolist(), first.tolist(), last.tolist()):
                runs[keys[i], codes[a:e].tobytes()] += 1
            held += int((last - first).sum())
            if held > _HELD:
                yield shared_runs()
                runs.clear()
                held = 0
        yield counted()
        yield shared_runs()
        yield pa.RecordBatch.from_pydict({"hash": [None], "key": [None], "words": [None], "c": [read]}, _SCANNED)

    return run


def _block_grams(coded: DataFrame, sizes: range) -> DataFrame:
    """hash, block: n-grams of the queries, with repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = _arrays(b.column(1))
            block = np.repeat(b.column(0).to_numpy(), np.diff(at))
            for n in sizes:
                where, g = grams(codes, _left(at), n)
                _, one = np.unique(mix(g) ^ mix(block[where].astype(np.uint64)), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(g[one])), pa.array(block[where[one]])], names=["hash", "block"])

    return coded.select("block", "codes").mapInArrow(lean(run), "hash bigint, block bigint").distinct()


def _block_runs(runs: DataFrame, coded: DataFrame) -> DataFrame:
    """block, key, words, c: the stretches of the runs that each block has."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size=PIECE):
            codes, at = _arrays(b.column(1))
            where, g = grams(codes, _left(at), SHORT + 1)
            row = row_ids(at)[where]
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(g)), pa.array(b.column(0).to_numpy()[row]), pa.array((where - at[row]).astype(np.int32))], names=["hash", "run", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size=PIECE):
            out: dict[tuple, int] = defaultdict(int)
            for block, key, words, c, at in zip(*(b.column(k).to_pylist() for k in range(5))):
                at = np.sort(np.array(at, np.int64))
                opens = np.concatenate([[True], np.diff(at) != 1])
                for a, e in zip(at[opens].tolist(), at[np.append(opens[1:], True)].tolist()):
                    out[block, key, words[8 * a : 8 * (e + SHORT + 1)]] += c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array([k[2] for k in out], pa.binary()), pa.array(list(out.values()), pa.int64())], names=["block", "key", "words", "c"])

    hits = runs.select("run", "words").mapInArrow(lean(places), "hash bigint, run bigint, place int").join(_block_grams(coded, range(SHORT + 1, SHORT + 2)), "hash").groupBy("run", "block").agg(F.collect_list("place").alias("at"))
    return hits.join(runs, "run").select("block", "key", "words", "c", "at").mapInArrow(lean(cut), "block bigint, key bigint, words binary, c bigint").groupBy("block", "key", "words").agg(F.sum("c").alias("c"))


def longest(shard: Shard, keys: np.ndarray, q: Run, words: np.ndarray, start: np.ndarray, own_keys: np.ndarray | None) -> np.ndarray:
    """For each start the longest match in the shard without documents of its own key. keys: of the shard's documents; own_keys: of the queries, ascending. The shard has at most one document with a query's key: that query as a whole."""
    doc = np.searchsorted(q.ends, start)
    most = q.ends[doc] - start
    out = shard.narrowed(q, words, start, most)[0].astype(np.int64)
    if own_keys is not None and len(own_keys):
        own = np.searchsorted(own_keys, keys)
        own[own == len(own_keys)] = 0
        mine = np.flatnonzero(own_keys[own] == keys)
        if len(mine):
            place = np.full(len(own_keys), -1)
            place[own[mine]] = mine
            here = np.flatnonzero(place[doc] >= 0)
            of = place[doc[here]]
            at = shard.run.ends[of] - most[here]
            # the nearest suffixes on either side that are of documents with another key
            same = np.unique(keys, return_inverse=True)[1][np.searchsorted(shard.run.ends, shard.order)]
            opens = np.concatenate([[True], same[1:] != same[:-1]])
            head = np.flatnonzero(opens)
            rank = np.empty(len(shard.order), np.int64)
            rank[shard.order] = np.arange(len(shard.order))
            run = np.cumsum(opens)[rank[at]] - 1
            best = np.zeros(len(here), np.int64)
            for side in (head[run] - 1, np.append(head, len(shard.order))[run + 1]):
                there = (side >= 0) & (side < len(shard.order))
                best[there] = np.maximum(best[there], common(q, start[here[there]], shard.run, shard.order[side[there]], np.zeros(int(there.sum()), np.int64), most[here[there]]))
            out[here] = best
    return out


def contexts(matched: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The longest context of each place from the longest match of each start: the first start, in its document, whose match reaches the place. docs: where each place's document begins."""
    i = np.arange(len(matched))
    return np.minimum(i - np.searchsorted(np.maximum.accumulate(i + matched), i), i - docs)


def _scored(rows: list[tuple[int, int, bytes]], hashes: np.ndarray, hash_counts: np.ndarray, runs: list[tuple[int | None, bytes, int]], total: int, mu: float, leave_out: bool, shard_words: int) -> list[dict]:
    """Scores of a block's rows (key, copies, codes), ascending by key. hashes: of its short n-grams that the corpus has, ascending, with their counts; runs: key, words, count."""
    docs = [np.frombuffer(r[2], np.uint64) for r in rows]
    keys, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    codes, ends = joined(docs)
    own = indexed(codes, ends)
    q, n = own.run, len(codes)
    different, which = np.unique(codes, return_inverse=True)
    own_words = numbers(own, different, which)
    of = np.searchsorted(ends, np.arange(n))
    left = ends[of] - np.arange(n)
    by_doc = np.sort(np.searchsorted(ends, own.order) * (n + 1) + np.arange(n))
    other = np.setdiff1d(np.arange(len(keys) + 1), keys)[0]  # what runs of no query row have for a key
    #: runs in shards of about shard_words words
    cuts = np.cumsum([len(w) // 8 for _, w, _ in runs]) // shard_words if runs else np.zeros(0, np.int64)

    def shards() -> Iterator[tuple[Shard, np.ndarray, np.ndarray, np.ndarray]]:
        """Each with its documents' keys, the runs before each suffix in its order, and the block's words as its numbers."""
        for k in np.unique(cuts):
            a, b = np.searchsorted(cuts, [k, k + 1])
            shard = indexed(*joined([np.frombuffer(w, np.uint64) for _, w, _ in runs[a:b]]))
            times = np.array([c for _, _, c in runs[a:b]], np.int64)[np.searchsorted(shard.run.ends, shard.order)]
            yield shard, np.array([other if x is None else x for x, _, _ in runs[a:b]], np.int64), np.concatenate([[0], np.cumsum(times)]), numbers(shard, different, which)

    held = [*shards()] if len(cuts) and cuts[0] == cuts[-1] else None

    def short(start: np.ndarray, size: int) -> np.ndarray:
        """How often the corpus has the words from each start."""
        g = rolled(codes, size)[start] + np.uint64(size)
        at = np.minimum(np.searchsorted(hashes, g), max(0, len(hashes) - 1))
        return np.where(hashes[at] == g, hash_counts[at], 0) if len(hashes) else np.zeros(len(g), np.int64)

    def held_by_own(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How often the query's own rows have them."""
        _, low, high = own.narrowed(q, own_words, start, size)
        mine = of[start] * (n + 1)
        return (np.searchsorted(by_doc, mine + high) - np.searchsorted(by_doc, mine + low)) * copies[of[start]]

    matched = np.zeros(n, np.int64)
    for size in range(1, SHORT + 1):
        start = np.flatnonzero(left >= size)
        there = short(start, size) - (held_by_own(start, np.full(len(start), size)) if leave_out else 0)
        matched[start[there > 0]] = size
    order = own.order[own.marks :]  # without the marks themselves; neighbours are looked up one after the other
    for shard, of_runs, _, as_numbers in held or shards():
        matched[order] = np.maximum(matched[order], longest(shard, of_runs, q, as_numbers, order, keys if leave_out else None))
    begins = np.concatenate([[0], ends[:-1] + 1])[of] if n else np.zeros(0, np.int64)
    context = contexts(matched, begins)
    word = np.ones(n, bool)
    word[ends] = False
    i = np.flatnonzero(word)
    long = context[i]
    asked = [(i, np.ones(len(i), np.int64), np.ones(len(i), bool)), (i - 1, np.ones(len(i), np.int64), long > 0), (i - 1, np.full(len(i), 2), long > 0), (i - long, long, long > 1), (i - long, long + 1, long > 1)]
    start, size = np.concatenate([s[ok] for s, _, ok in asked]), np.concatenate([m[ok] for _, m, ok in asked])
    rank = np.zeros(n, np.int64)
    rank[order] = np.arange(len(order))
    _, first, back = np.unique(mix(q.hash(start, size) + size.astype(np.uint64)), return_index=True, return_inverse=True)
    by_rank = np.argsort(rank[start[first]], kind="stable")
    place = np.empty(len(by_rank), np.int64)
    place[by_rank] = np.arange(len(by_rank))
    nodes, lengths = start[first][by_rank], size[first][by_rank]
    counts = np.zeros(len(nodes), np.int64)
    for m in range(1, SHORT + 1):
        some = np.flatnonzero(lengths == m)
        counts[some] = short(nodes[some], m)
    some = np.flatnonzero(lengths > SHORT)
    for shard, _, before, as_numbers in (held or shards()) if len(some) else ():
        depth, low, high = shard.narrowed(q, as_numbers, nodes[some], lengths[some])
        counts[some] += np.where(depth == lengths[some], before[high] - before[low], 0)
    counts = counts[place[back]]
    if leave_out:
        counts -= held_by_own(start, size)
    rest = total - (np.array([len(d) for d in docs], np.int64) * copies if leave_out else np.zeros(len(docs), np.int64))
    c, k = [], 0
    for s, _, ok in asked:
        x = np.zeros(len(s), np.int64)
        x[ok] = counts[k : k + int(ok.sum())]
        c.append(x)
        k += int(ok.sum())
    left = rest[of[i]].astype(float)
    p = (c[0] + mu / (left + 1)) / (left + mu)
    p = np.where(long > 0, (c[2] + mu * p) / (c[1] + mu), p)
    p = np.where(long > 1, (c[4] + mu * p) / (c[3] + mu), p)
    out, log = [], np.log(p)
    edges = np.searchsorted(of[i], np.arange(len(docs) + 1))
    for d, r in enumerate(rows):
        a, b = edges[d], edges[d + 1]
        if a == b:
            out.append({"key": r[0], "n_words": 0, "log_prob": None, "perplexity": None, "mean_context": None, "longest_context": None, "unseen": 0})
            continue
        total_log = math.fsum(log[a:b])
        out.append({"key": r[0], "n_words": int(b - a), "log_prob": total_log, "perplexity": math.exp(-total_log / (b - a)), "mean_context": float(long[a:b].mean()), "longest_context": int(long[a:b].max()), "unseen": int((c[0][a:b] <= 0).sum())})
    return out


SCORES = "key bigint, n_words int, log_prob double, perplexity double, mean_context double, longest_context int, unseen int"
_SCORES = pa.schema([("key", pa.int64()), ("n_words", pa.int32()), ("log_prob", pa.float64()), ("perplexity", pa.float64()), ("mean_context", pa.float64()), ("longest_context", pa.int32()), ("unseen", pa.int32())])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes, at = word_codes(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([codes[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["key", "copies", "codes"])


def scores(corpus: DataFrame, queries: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", query_text: str = "text", every: int = EVERY, mu: float = MU, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id_col, n_words, log_prob (natural, of the whole text), perplexity, mean_context and longest_context (words of the longest contexts found), unseen (words that the corpus lacks): a row for each row of queries.
    With queries, id_col and query_text are theirs. Without, these are the corpus' rows whose id_col is divisible by every, and each is scored against all other rows."""
    spark = corpus.sparkSession
    key = lambda i, t: F.xxhash64(i.cast("string"), t.cast("string"))
    leave_out = queries is None
    if queries is None:
        queries, query_text = corpus.where(F.pmod(F.col(id_col).cast("bigint"), F.lit(every)) == 0), text_col
    rows = queries.select(F.col(id_col), key(F.col(id_col), F.col(query_text)).alias("key"), F.col(query_text).cast("string").alias("text"))
    coded = written(rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("key", "text", "copies").mapInArrow(lean(_coded), "key bigint, copies bigint, codes binary"), "queries")
    asked = coded.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()[0] // 8
    blocks = max(1, math.ceil(asked / block_words))
    blocked = coded.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("bigint"))
    shared = spark.sparkContext.broadcast(_sieves(coded, asked))
    own = F.when(F.pmod(F.col(id_col).cast("bigint"), F.lit(every)) == 0, key(F.col(id_col), F.col(text_col))) if leave_out else F.lit(None).cast("bigint")
    scanned = written(corpus.select(own.alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_scanning(shared)), SCANNED), "scanned")
    shared.unpersist()
    total = scanned.where("hash IS NULL AND words IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = scanned.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("c").alias("c")).join(_block_grams(blocked, range(1, SHORT + 1)), "hash")
    runs = written(scanned.where("words IS NOT NULL").groupBy("key", "words").agg(F.sum("c").alias("c")).withColumn("run", F.monotonically_increasing_id()), "runs")
    found = counts.select("block", "hash", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("words"), "c").unionByName(_block_runs(runs, blocked).withColumn("hash", F.lit(None).cast("bigint")))

    def scored(asking: pa.Table, found: pa.Table) -> pa.Table:
        settle()
        asking = asking.sort_by("key")
        short = found.filter(pc.is_valid(found.column("hash")))
        hashes, counts = short.column("hash").to_numpy().view(np.uint64), short.column("c").to_numpy()
        by = np.argsort(hashes)
        long = found.filter(pc.is_valid(found.column("words")))
        out = _scored(list(zip(*(asking.column(c).to_pylist() for c in ("key", "copies", "codes")))), hashes[by], counts[by], list(zip(*(long.column(c).to_pylist() for c in ("key", "words", "c")))), total, mu, leave_out, shard_words) if asking.num_rows else []
        return pa.Table.from_pylist(out, _SCORES)

    done = written(blocked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored, SCORES), "scores")
    discard(scanned, runs, coded)
    return rows.drop("text").join(done, "key").drop("key")
