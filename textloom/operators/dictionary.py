"""Changing a lexicon: words, other spellings, words analysed beforehand, rules over all forms of a tag, words found in a corpus. Entries are tables (see sources.lexicon); each function gives a new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lexicon import ENTRY
from . import analyzer, stats


def _same() -> Column:
    return F.struct("surface", F.transform("analysis", lambda a: F.struct(a.form, a.tag)), "is_rule", "sense")


def union(*entries: DataFrame) -> DataFrame:
    """All entries; of those equal in surface, analysis and sense the first table's."""
    all_ = entries[0].withColumn("o", F.lit(0))
    for k, e in enumerate(entries[1:], 1):
        all_ = all_.unionByName(e.withColumn("o", F.lit(k)))
    return all_.withColumn("n", F.row_number().over(Window.partitionBy(_same()).orderBy("o", F.desc("score")))).where("n = 1").drop("n", "o")


def without(entries: DataFrame, blocked: DataFrame) -> DataFrame:
    """Entries none of whose morphemes is in blocked(form, tag)."""
    gone = entries.select("surface", "analysis", F.explode("analysis").alias("a")).join(blocked.select(F.col("form"), F.col("tag")), (F.col("a.form") == F.col("form")) & (F.split_part("a.tag", F.lit("-"), F.lit(1)) == F.split_part("tag", F.lit("-"), F.lit(1)))).select("surface", "analysis").distinct()
    return entries.join(gone, ["surface", "analysis"], "left_anti").select(*entries.columns)


def add_word(entries: DataFrame, form: str, tag: str, score: float = 0.0, dialect: int = 0, sense: int | None = None) -> tuple[DataFrame, bool]:
    """The entries with the word, and whether it is new; a known word stays as it is."""
    spark = entries.sparkSession
    known = entries.where((F.col("surface") == form) & (F.size("analysis") == 1) & (F.col("analysis")[0].tag == tag) & F.col("sense").eqNullSafe(F.lit(sense))).limit(1).count()
    if known:
        return entries, False
    return entries.unionByName(spark.createDataFrame([(form, [(form, tag, sense)], False, score, dialect, sense)], ENTRY)), True


def add_alias(entries: DataFrame, new: str, form: str, tag: str, penalty: float = 0.0) -> DataFrame:
    """Another spelling of a word, which is analysed and scored as that word; ValueError if there is none."""
    known = entries.where((F.col("surface") == form) & (F.size("analysis") == 1) & (F.split_part(F.col("analysis")[0].tag, F.lit("-"), F.lit(1)) == tag)).limit(1)
    if not known.count():
        raise ValueError(f"no word {form}/{tag}")
    return union(entries, known.withColumn("surface", F.lit(new)).withColumn("score", F.col("score") + penalty))


def add_analysed(entries: DataFrame, surface: str, morphs: list[tuple[str, str]], score: float = 0.0, dialect: int = 0) -> DataFrame:
    """A surface that is several morphemes; ValueError without any."""
    if not morphs:
        raise ValueError("a word has a morpheme at least")
    new = entries.sparkSession.createDataFrame([(surface, [(f, t, None) for f, t in morphs], False, score, dialect, None)], ENTRY)
    return union(entries, new)


def add_rule(entries: DataFrame, tag: str, change: Callable[[Column], Column], penalty: float = 0.0) -> DataFrame:
    """Another spelling of every form of a tag: change makes it from the surface; forms that it leaves alone get none."""
    new = entries.where((F.size("analysis") == 1) & ~F.col("is_rule") & (F.split_part(F.col("analysis")[0].tag, F.lit("-"), F.lit(1)) == tag))
    new = new.withColumn("n", change(F.col("surface"))).where(F.col("n") != F.col("surface")).withColumn("surface", F.col("n")).drop("n").withColumn("score", F.col("score") + penalty)
    return union(entries, new)


def extract_words(docs: DataFrame, text_col: str = "text", least: int = 10, longest: int = 10, least_score: float = 0.1, model: analyzer.Model | None = None) -> DataFrame:
    """form, n, score of stats.word_candidates() that the model doesn't know as one word, and that it doesn't read as a word with a particle or ending."""
    found = stats.word_candidates(stats.word_counts(docs, text_col), least, longest, least_score)
    if model is None:
        return found.select("form", "n", "score")
    read = analyzer.analyze(found.select("form", "n", "score"), "form", "form", model)
    fine = read.where("rank = 1").where(~F.exists("tokens", lambda t: t.tag.startswith("J") | t.tag.startswith("E")) & ~((F.size("tokens") == 1) & (F.element_at("tokens", 1).morpheme_id >= 0))).select(F.col("id").alias("form"))
    return found.join(fine, "form", "left_semi").select("form", "n", "score")
