"""Language identification with hyperdimensional profiles.

Each letter (any code point that is one; all else between words is one gap) has a random vector of DIMENSIONS signs, made from the seed and its code point. A trigram's vector binds (multiplies) its
letters' vectors, permuted (rotated) by their place; a text's vector bundles (sums) its trigrams' vectors; a language's prototype is the bundle of its documents.
A document goes to the language whose prototype has the largest cosine with it; its own part is taken out of its own language's prototype first, so that no document is compared with itself.

All sums are exact whole numbers. Prototypes are added up by task, one vector for each language that a task meets: their size doesn't depend on the data. Fewer than 8,000 languages are known; more than MOST_LANGUAGES different
names are refused with an error, since every task holds all prototypes (8 kB each).

Defined cases: null or empty texts, and those without letters, have no trigram: predicted, cosine and margin are null; rows with a null language take no part in the prototypes but are
identified; without any prototype all are null; a prototype of which nothing is left, or whose sum is zero, has cosine 0; equal cosines go to the alphabetically first language; rows that repeat count as often as they stand there. Extra columns stay and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 11
MOST_LANGUAGES = 10_000
#: Trigrams of a text whose vectors are made at once.
_AT_ONCE = 4096
_LETTER = np.zeros(0x110000, bool)
for _a, _b in ((0x41, 0x250), (0x250, 0x2000), (0x2C00, 0x2FF0), (0x3040, 0xD800), (0xF900, 0xFE00), (0xFE70, 0x10000), (0x10000, 0x32000)):
    _LETTER[_a:_b] = [chr(c).isalpha() for c in range(_a, _b)]


def letters(text: str) -> np.ndarray:
    """Code points of a lower-cased text: runs of other characters are one gap (0), as are both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    s = np.where(_LETTER[points], points, 0).astype(np.int64)
    s = np.concatenate([[0], s, [0]])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a lower-cased text, 21 bits for each letter, and how often each stands there."""
    s = letters(text)
    return np.unique((s[:-2] << 42) | (s[1:-1] << 21) | s[2:], return_counts=True) if len(s) > 2 else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Space:
    """The letters' vectors, made when first needed, and their rotations."""

    def __init__(self, seed: int = SEED, dimensions: int = DIMENSIONS) -> None:
        self.seed, self.dimensions = seed, dimensions
        self.place: dict[int, int] = {}
        self.rolled = np.zeros((3, 64, dimensions), np.int8)

    def _of(self, points: np.ndarray) -> np.ndarray:
        different, which = np.unique(points, return_inverse=True)
        at = []
        for p in different.tolist():
            if p not in self.place:
                k = self.place[p] = len(self.place)
                if k == self.rolled.shape[1]:
                    self.rolled = np.concatenate([self.rolled, np.zeros_like(self.rolled)], axis=1)
                v = np.random.default_rng((self.seed, p)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
                for r in range(3):
                    self.rolled[r, k] = np.roll(v, 2 - r)
            at.append(self.place[p])
        return np.array(at, np.int64)[which]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for k in range(0, len(grams), _AT_ONCE):
            g = grams[k : k + _AT_ONCE]
            x, y, z = (self._of(p) for p in (g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF))
            total += counts[k : k + _AT_ONCE].astype(np.float32) @ (self.rolled[0, x] * self.rolled[1, y] * self.rolled[2, z]).astype(np.float32)
        return np.rint(total)


def _counted(seed: int, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = Space(seed, dimensions), {}
        for b in batches:
            held: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), pc.utf8_lower(b.column(1))):
                held.setdefault(lang, []).append(trigrams(text.as_py() or ""))
            for lang, parts in held.items():
                grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(which, np.concatenate([c for _, c in parts]), len(grams))
                # float32 sums of at most 2^24 are whole: larger counts go in digits
                for digit in range(4):
                    part = np.floor(counts / 4096**digit) % 4096
                    some = part > 0
                    if some.any():
                        total[lang] = total.get(lang, 0) + space.bundle(grams[some], part[some]) * 4096**digit
                total.setdefault(lang, np.zeros(dimensions))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], names=["lang", "bundle"])

    return run


def _summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [key[0]], "bundle": [sum(np.frombuffer(x, np.int64) for x in pdf["bundle"]).tobytes()]})


def profile(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from all rows that name their language: one scan, one vector for each task and language."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    rows = known.mapInArrow(_counted(seed, dimensions), "lang string, bundle binary").groupBy("lang").applyInPandas(_summed, "lang string, bundle binary").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = sorted(rows)
    return [r.lang for r in rows], np.array([np.frombuffer(r.bundle, np.int64) for r in rows], np.float64).reshape(len(rows), dimensions)


def cosines(bundle: np.ndarray, prototypes: np.ndarray, squares: np.ndarray, own: int | None) -> np.ndarray:
    """Of a document with each prototype; its own language's without it."""
    square = float(bundle @ bundle)
    dots, norms = prototypes @ bundle, squares.copy()
    if own is not None:
        norms[own] += square - 2 * dots[own]
        dots[own] -= square
    out = np.zeros(len(dots))
    some = norms * square > 0
    out[some] = dots[some] / np.sqrt(norms[some] * square)
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = SEED) -> DataFrame:
    """doc_id, lang, predicted, cosine, margin (to the next language) for every row: one scan, no shuffle. The model has the row if the row names a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang string, predicted string, cosine double, margin double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value
        space, place, squares = Space(seed, prototypes.shape[1]), {n: k for k, n in enumerate(names)}, (prototypes**2).sum(axis=1)
        for b in batches:
            out = []
            for lang, text in zip(b.column(1).to_pylist(), pc.utf8_lower(b.column(2))):
                grams, counts = trigrams(text.as_py() or "")
                if not len(grams) or not names:
                    out.append((None, None, None))
                    continue
                cosine = cosines(space.bundle(grams, counts), prototypes, squares, place.get(lang))
                best = int(np.argmax(cosine))
                rest = np.delete(cosine, best)
                out.append((names[best], round(float(cosine[best]), 6), round(float(cosine[best] - rest.max()), 6) if len(rest) else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64())))], names=["doc_id", "lang", "predicted", "cosine", "margin"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(scored, schema)


def languages(docs: DataFrame, **columns) -> DataFrame:
    return identify(docs, profile(docs, columns.get("text_col", "text"), columns.get("lang_col", "lang")), **columns)
