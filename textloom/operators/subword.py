"""Subword units of a given vocabulary: the best cut of each word by unigram log probabilities, bytes for what the vocabulary lacks, and back again exactly.

A vocabulary row is (form, tag, kind, lprob). Kinds: "special" (never cut from text), "word" (at the beginning of a word), "piece" (inside one), "morph" (a morpheme with its tag), "byte" (form 00 to FF), "glue" (one: no space here).
A space between words is not written; other white space is bytes between glue. Vocabularies are given, never trained.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .combiner import Joiner, joined

Row = tuple[str, str | None, str, float]
_SPLIT = regex.compile(r"\s+|\S+")


@dataclass
class Subword:
    rows: list[Row]
    unknown: float = -30.0

    def __post_init__(self) -> None:
        kinds: dict[str, dict] = {"word": {}, "piece": {}, "morph": {}, "byte": {}, "glue": {}, "special": {}}
        for i, (form, tag, kind, lprob) in enumerate(self.rows):
            if kind not in kinds:
                raise ValueError(f"no such kind: {kind}")
            key = (form, tag) if kind == "morph" else int(form, 16) if kind == "byte" else form
            if key in kinds[kind]:
                raise ValueError(f"{form} stands twice in the vocabulary")
            if not math.isfinite(lprob):
                raise ValueError(f"{form} has no log probability")
            kinds[kind][key] = (i, lprob)
        self.by = kinds
        self.longest = max((len(f) for f, _, k, _ in self.rows if k in ("word", "piece")), default=0)
        if len(kinds["byte"]) not in (0, 256) or len(kinds["glue"]) != 1:
            raise ValueError("a vocabulary has one glue token and all bytes, or none")
        self.glue = next(iter(kinds["glue"].values()))[0]

    def _bytes(self, text: str) -> list[int]:
        if not self.by["byte"]:
            raise ValueError(f"neither pieces nor bytes for {text!r}")
        return [self.by["byte"][b][0] for b in text.encode("utf-8", "surrogatepass")]

    def cut(self, word: str) -> list[int]:
        """The best cut of a word: the largest sum of log probabilities; a character that no piece has is bytes."""
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)] + [(-math.inf, 0, None)] * len(word)
        for i in range(len(word)):
            if best[i][0] == -math.inf:
                continue
            table = self.by["piece"] if i else self.by["word"]
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                if (hit := table.get(word[i:j])) and best[i][0] + hit[1] > best[j][0]:
                    best[j] = (best[i][0] + hit[1], i, hit[0])
            if best[i][0] + self.unknown > best[i + 1][0]:
                best[i + 1] = (best[i][0] + self.unknown, i, None)
        out: list[list[int]] = []
        j = len(word)
        while j:
            _, i, token = best[j]
            out.append([token] if token is not None else [*([] if i else [-1]), *self._bytes(word[i:j])])
            j = i
        return [t for part in reversed(out) for t in part]

    def encode(self, text: str | None) -> list[int] | None:
        if text is None:
            return None
        out: list[int] = []
        plain = True  # whether the next word's space is understood, or none is needed
        for m in _SPLIT.finditer(text):
            part = m.group()
            if part.isspace():
                if part == " " and m.start() and m.end() < len(text):
                    plain = True
                else:
                    out += [self.glue, *self._bytes(part)]
                    plain = False
                continue
            if not plain:
                out.append(self.glue)
            tokens = self.cut(part)
            if tokens[0] == -1:  # bytes begin the word: the space has to be written unless there is none
                tokens = tokens[1:]
                if out and plain:
                    out += self._bytes(" ")
                elif out:
                    out.pop()
            out += tokens
            plain = True
        return out

    def encode_morphs(self, tokens: list) -> list[int]:
        """Of (form, tag): a morpheme's own token if it has one, otherwise the best cut of its form, with glue where no space stands before it."""
        out: list[int] = []
        joiner, text = Joiner(), ""
        for form, tag in tokens:
            before = joiner.text()
            joiner.add(form, tag)
            text = joiner.text()
            if before and not text[len(before) :].startswith(" "):
                out.append(self.glue)
            hit = self.by["morph"].get((form, tag))
            out += [hit[0]] if hit else [t for t in self.cut(form) if t >= 0]
        return out

    def decode(self, ids: list[int] | None, errors: bool = True) -> str | None:
        """The inverse of encode(). Bytes that are no text become U+FFFD; unknown ids fail, or with errors=False are left out. Morphemes are put together by their sound changes."""
        if ids is None:
            return None
        out, held, glued, morphs = "", b"", False, []

        def flush() -> None:
            nonlocal out, held, morphs
            if held:
                out += held.decode("utf-8", "surrogatepass" if b"\xed" in held else "replace")
                held = b""
            if morphs:
                out += joined(morphs)
                morphs = []

        for i in ids:
            if not 0 <= i < len(self.rows):
                if errors:
                    raise ValueError(f"no token {i}")
                continue
            form, tag, kind, _ = self.rows[i]
            if kind == "byte":
                if morphs:
                    flush()
                held += bytes([int(form, 16)])
                glued = False
                continue
            if kind == "morph":
                if not morphs:
                    flush()
                    if out and not glued:
                        out += " "
                morphs.append((form, tag))
                glued = False
                continue
            if kind == "glue":
                glued = True
                continue
            flush()
            if kind == "word" and out and not glued:
                out += " "
            if kind != "special":
                out += form
            glued = False
        flush()
        return out

    def to_json(self) -> str:
        return json.dumps({"version": 1, "unknown": self.unknown, "vocab": self.rows}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Subword:
        x = json.loads(text)
        return cls([tuple(r) for r in x["vocab"]], x["unknown"])


def with_bytes(rows: list[Row]) -> list[Row]:
    """A vocabulary with glue and all bytes in front of its rows."""
    return [("+", None, "glue", 0.0), *[(f"{b:02X}", None, "byte", -12.0) for b in range(256)], *rows]


def vocabulary(df: DataFrame) -> Subword:
    """From rows id, form, tag, kind, lprob, in the order of id."""
    return Subword([(r.form, r.tag, r.kind, r.lprob) for r in df.orderBy("id").collect()])


def encode(df: DataFrame, id_col: str, text_col: str, subword: Subword) -> DataFrame:
    """id, ids array<int>; null texts have null."""
    shared = df.sparkSession.sparkContext.broadcast(subword)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str, ids_col: str, subword: Subword) -> DataFrame:
    """id, text: the inverse of encode()."""
    shared = df.sparkSession.sparkContext.broadcast(subword)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.decode(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
