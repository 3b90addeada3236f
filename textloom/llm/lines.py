"""Line dedup by winnowing over line hashes.

A text is cut into lines: at newlines, and within those at sentence ends, so that a passage pasted into a paragraph is lines too. A
line's hash is that of its words (case and punctuation don't count); lines without words are no lines. At each line a gram begins: the
fewest lines from there on that have GRAM_WORDS words together. At each line a window begins too: the fewest lines that have WINDOW_WORDS
words. Of the grams within a window the one with the smallest hash (the last of equal ones) is a fingerprint. It depends on the window's lines
only, so that a repeated run of WINDOW_WORDS words or more always shares one, wherever it stands and however long its lines are.

Fingerprints are joined by position, in the order of (doc_id, position), nulls first: a match is extended both ways line by line while the lines are
those beside any earlier occurrence. Each fingerprint carries the hashes of the lines within WINDOW_WORDS words on either side; no run goes further
without another fingerprint, since its windows choose grams less than that apart. What is covered is deleted from the later place; a run's first
occurrence stays. Each fingerprint is one row of a shuffle, whatever the number of its copies; no pairs are built.

Defined cases: null and empty texts have no lines and stay; a document of fewer than WINDOW_WORDS words has one window of all its grams; one of fewer than GRAM_WORDS words has no gram and stays;
rows with equal doc_id and text are one document and are cut alike, as are rows without doc_id and equal text; rows with equal doc_id but different text are
different documents; within a document a match that overlaps the first occurrence is not cut. A document of which all lines go becomes empty and, as a stage, is dropped. Extra columns stay and take no part.
"""

from __future__ import annotations

import math
import struct
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_signed, free_names, lean, mix, pieces, ranges, row_ids, sized, word_codes, written

GRAM_WORDS = 25
#: The least words of a repeated run that must be found: over 50.
WINDOW_WORDS = 51
#: A line ends after a newline, or after closing punctuation and the white space behind it.
END = r"\n+|\x1e|(?<=[.!?])[ \t]+"
_CUT = regex.compile(END)
SCHEMA = "fp bigint, doc_id bigint, doc bigint, at int, lines int, before binary, after binary"


def cut(text: str) -> list[str]:
    """The lines of a text, each with what ends it: together they are the text."""
    out, here = [], 0
    for m in _CUT.finditer(text):
        out.append(text[here : m.end()])
        here = m.end()
    out.append(text[here:])
    return out


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that have words: hash, words, row."""
    # RE2 has no look-behind, so a mark goes after the end of a line and the cut is at marks
    marked = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"\n+|([.!?])[ \t]+", "\\1\x1e")
    parts = pc.split_pattern(marked, "\x1e")
    flat, at = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    codes, word_at = word_codes(flat)
    count = np.diff(word_at)
    place = np.arange(len(codes)) - np.repeat(word_at[:-1], count)
    spread = mix(codes + mix(place.astype(np.uint64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    hashes = mix(total[word_at[1:]] - total[word_at[:-1]])
    rows = row_ids(at)
    some = count > 0
    return hashes[some], count[some], rows[some]


def _pick(gram: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of grams x and y (indices, x not after y) that with the smaller hash, y of equal ones."""
    return np.where(gram[y] <= gram[x], y, x)


def fingerprints(hashes: np.ndarray, count: np.ndarray, rows: np.ndarray, n_rows: int, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the selected grams of all rows: hash, first line (index into hashes), end line, and words."""
    n = len(hashes)
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    words = np.concatenate([[0], np.cumsum(count)])
    end = np.searchsorted(words, words[:-1] + gram_words)
    ok = end <= at[rows + 1]
    first = np.flatnonzero(ok)
    if not len(first):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    end, of = end[first], rows[first]
    powered = mix(hashes)
    gram = np.zeros(len(first), np.uint64)
    for k in range(int((end - first).max())):
        inside = first + k < end
        gram[inside] = mix(gram[inside] * np.uint64(0x9E3779B97F4A7C15) + powered[first[inside] + k])
    # the grams of a row stand together: those within the window that opens with one are the ones up to stop; a row without a whole window has one of all
    shut = np.searchsorted(words, words[first] + window_words)
    whole = shut <= at[of + 1]
    head = np.arange(len(gram)) == np.searchsorted(of, of)
    opens = np.flatnonzero(whole | head)
    stop = np.searchsorted(end, np.where(whole, shut, at[of + 1])[opens], side="right")
    # the smallest of each 2^k grams that follow each other, then of each window by two of those
    best, level = np.arange(len(gram)), np.frexp(stop - opens)[1] - 1
    chosen = []
    for k in range(int(level.max()) + 1):
        here = level == k
        chosen.append(_pick(gram, best[opens[here]], best[stop[here] - (1 << k)]))
        if len(best) > 1 << k:
            best = _pick(gram, best[: -(1 << k)], best[1 << k :])
    chosen = np.unique(np.concatenate(chosen))
    return gram[chosen], first[chosen], end[chosen], words[end[chosen]] - words[first[chosen]]


def _side(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, outwards: int) -> pa.Array:
    """The hashes of lines begin to end of each posting as bytes, from the match outwards."""
    size = end - begin
    at = ranges(begin, size) if outwards > 0 else np.repeat(end - 1 + np.cumsum(size) - size, size) - np.arange(int(size.sum()))
    offsets = (8 * np.concatenate([[0], np.cumsum(size)])).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes[at].astype("<u8").tobytes())])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        hashes, count, rows = line_hashes(b.column(1))
        fp, first, end, _ = fingerprints(hashes, count, rows, b.num_rows)
        of = rows[first]
        at = np.searchsorted(rows, np.arange(b.num_rows + 1))
        words = np.concatenate([[0], np.cumsum(count)])
        # lines on either side that begin (or end) less than WINDOW_WORDS words from the match: what a run can have beyond its last fingerprint, and the line that ends it
        low = np.maximum(np.searchsorted(words, words[first] - WINDOW_WORDS, side="right") - 1, at[of])
        high = np.minimum(np.searchsorted(words, words[end] + WINDOW_WORDS), at[of + 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(as_signed(fp)), b.column(0).take(pa.array(of)), b.column(2).take(pa.array(of)), pa.array((first - at[of]).astype(np.int32)), pa.array((end - first).astype(np.int32)), _side(hashes, low, first, -1), _side(hashes, end, high, 1)],
            names=["fp", "doc_id", "doc", "at", "lines", "before", "after"],
        )


class _Seen:
    """The occurrences of one fingerprint so far, in order: how far the lines beside a new one are those beside any of them."""

    def __init__(self) -> None:
        self.source: int | None = None
        self.doc: int | None = None
        self.at = -1
        #: By side, hashes of the lines from the match outwards, of one line, two and so on: those of earlier documents, and of this one with the least end of a match that has them.
        self.others: tuple[set[int], set[int]] = (set(), set())
        self.own: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.waiting: deque[tuple[int, list[int], list[int]]] = deque()
        self.any = False

    def _own(self, before_line: float) -> None:
        while self.waiting and self.waiting[0][0] <= before_line:
            end, *sides = self.waiting.popleft()
            for own, keys in zip(self.own, sides):
                for k in keys:
                    own.setdefault(k, end)

    def add(self, doc_id: int | None, doc: int, at: int, lines: int, before: bytes, after: bytes) -> tuple[int, int] | None:
        """first_line and end_line of what is deleted, if there is an earlier occurrence that doesn't overlap."""
        sides = [list(accumulate(struct.unpack(f"<{len(x) // 8}q", x), lambda h, y: hash((h, y)), initial=0)) for x in (before, after)]
        if doc != self.doc:
            if self.doc is None:
                self.source = doc_id
            else:
                self._own(math.inf)
                self.any = True
                for others, own in zip(self.others, self.own):
                    others.update(own)
                    own.clear()
            self.doc = doc
        elif at == self.at:
            return None
        self.at = at
        self._own(at)
        found = None
        if self.any or self.own[0]:
            reach = []
            for k, (others, own, keys) in enumerate(zip(self.others, self.own, sides)):
                n = 0
                while n + 1 < len(keys) and (keys[n + 1] in others or (keys[n + 1] in own and (k == 1 or at - n - 1 >= own[keys[n + 1]]))):
                    n += 1
                reach.append(n)
            found = at - reach[0], at + lines + reach[1]
        self.waiting.append((at + lines, *sides))
        return found


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings in the order of fp and place: each that has an earlier one."""
    last, seen = None, _Seen()
    for b in batches:
        fp = b.column(0).to_numpy()
        if not len(fp):
            continue
        # a posting alone with its fingerprint needs no look; the batch's last may go on in the next
        same = fp[1:] == fp[:-1]
        look = np.concatenate([[fp[0] == last], same]) | np.concatenate([same, [True]])
        out: list[tuple] = []
        for f, *posting in zip(*(c.to_pylist() for c in b.filter(pa.array(look)).columns)):
            if f != last:
                last, seen = f, _Seen()
            if found := seen.add(*posting):
                out.append((posting[0], posting[1], *found, seen.source))
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "doc", "first_line", "end_line", "source_doc_id"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc (hash of id and text), first_line, end_line, source_doc_id (of the fingerprint's first occurrence): each match of a fingerprint with the earlier ones, extended.

    Occurrences with the same lines on both sides are one variant. Of each variant only the first document goes through _matched(), one fingerprint after the other; in every later document the variant's lines are
    all there before, so it extends as far as they are carried, which a join tells (split by Spark where one variant is a third of all rows). Variants, not documents, are what one task sees of a fingerprint."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    posts = written(plain.mapInArrow(lean(_postings), SCHEMA), "postings")
    variant = F.xxhash64("fp", "before", "after").alias("variant")
    place = F.struct("doc_id", "doc", "at")
    # a fingerprint that stands once only has nothing to match: counts are summed before the shuffle
    twice = posts.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    twice = written(twice, "fingerprints")
    shared = posts.join(sized(twice, twice.count()), "fp", "left_semi").withColumn("variant", variant)
    first = written(shared.groupBy("variant", "fp").agg(F.min(place).alias("m")), "variants")
    source = first.groupBy("fp").agg(F.min("m").alias("s")).select("fp", F.col("s.doc_id").alias("source_doc_id"))
    known = first.join(source, "fp").select("variant", F.col("m.doc").alias("first_doc"), "source_doc_id")
    tagged = shared.join(known, "variant")
    there = tagged.where("doc != first_doc").select("doc_id", "doc", (F.col("at") - F.length("before") / 8).cast("int").alias("first_line"), (F.col("at") + F.col("lines") + F.length("after") / 8).cast("int").alias("end_line"), "source_doc_id")
    new = tagged.where("doc = first_doc").select("fp", "doc_id", "doc", "at", "lines", "before", "after")
    return new.repartition("fp").sortWithinPartitions("fp", "doc_id", "doc", "at").mapInArrow(lean(_matched), "doc_id bigint, doc bigint, first_line int, end_line int, source_doc_id bigint").unionByName(there)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc, runs array<struct<first_line, end_line, source_doc_id>> in order: what is deleted from each document that loses lines. Overlapping and touching matches are one run, whose
    source is that of its first match. Lines are counted from 0 among those that have words; end_line is the first that stays."""
    matches = repeats(docs, id_col, text_col).distinct()
    order = Window.partitionBy("doc").orderBy("first_line", "end_line", "source_doc_id")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.withColumn("opens", F.coalesce((F.col("first_line") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy("doc", "run").agg(F.any_value("doc_id").alias("doc_id"), F.min("first_line").alias("first_line"), F.max("end_line").alias("end_line"), F.min(F.struct("first_line", "end_line", "source_doc_id")).alias("m"))
    return merged.select("doc_id", "doc", "first_line", "end_line", F.col("m.source_doc_id").alias("source_doc_id"))


def run_report(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, source_doc_id, first_line, end_line: one row for each deleted run."""
    return runs(docs, **columns).select("doc_id", "source_doc_id", "first_line", "end_line")


def without_lines(text: str, spans: list[tuple[int, int]]) -> str:
    parts, kept, k = cut(text), [], 0
    gone = {i for a, b in spans for i in range(a, b)}
    for p in parts:
        if WORD.search(p):
            if k not in gone:
                kept.append(p)
            k += 1
        else:
            kept.append(p)
    return "".join(kept)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the later repeated runs; documents of which no word stays though they had some are dropped; n_chars follows the text."""
    key, cuts = free_names(docs, "doc_key", "cut_runs")
    gone = written(runs(docs, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("first_line", "end_line")).alias(cuts)), "runs")
    n, spans = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(cuts)), F.lit(0))).first()
    tagged = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)))
    joined = tagged.join(sized(gone.withColumnRenamed("doc", key), n, 32 * spans / max(1, n)), key, "left").select(*docs.columns, cuts)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, spans = b.schema.names, b.column(b.schema.names.index(cuts))
            hit = np.flatnonzero(pc.is_valid(spans).to_numpy(zero_copy_only=False))
            keep, columns = np.ones(b.num_rows, bool), {n: b.column(k) for k, n in enumerate(names) if n != cuts}
            if len(hit):
                texts = columns[text_col].to_pylist()
                sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i in hit:
                    texts[i] = without_lines(texts[i], [(s["first_line"], s["end_line"]) for s in spans[i].as_py()])
                    keep[i] = WORD.search(texts[i]) is not None
                    if sizes:
                        sizes[i] = len(texts[i])
                columns[text_col] = pa.array(texts, columns[text_col].type)
                if sizes:
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep))

    return joined.mapInArrow(lean(cleaned), docs.schema)
