"""Hangul and whitespace expressions, all built-in. Positions and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(c: Column) -> Column:
    return F.ascii(c)


def char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _is_syllable(c: Column) -> Column:
    return point(c).between(0xAC00, 0xD7A3)


def normalize_hangul(text: Column) -> Column:
    """Each syllable with a coda becomes the open syllable and the conjoining coda (U+11A8 and on); 됬 is read as 됐."""
    def one(c: Column) -> Column:
        code = F.when(point(c) == 0xB42C, F.lit(0xB410)).otherwise(point(c)).cast("bigint")
        coda = (code - 0xAC00) % 28
        return F.when(_is_syllable(c) & (coda > 0), F.concat(char(code - coda), char(coda + 0x11A7))).otherwise(F.when(point(c) == 0xB42C, F.lit("됐")).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def has_coda(text: Column) -> Column:
    """Whether the last character is a syllable with a coda."""
    c = F.right(text, F.lit(1))
    return _is_syllable(c) & ((point(c) - 0xAC00) % 28 > 0)


def particle(noun: Column, after_coda: str, after_vowel: str, vocalic: bool = False) -> Column:
    """noun with the form of a particle that fits its ending; vocalic: ㄹ counts as a vowel (로, 으로)."""
    c = F.right(noun, F.lit(1))
    closed = has_coda(noun) & ((point(c) - 0xAC00) % 28 != 8) if vocalic else has_coda(noun)
    return F.concat(noun, F.when(closed, F.lit(after_coda)).otherwise(F.lit(after_vowel)))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f]+", " "))
