"""Models on disk: the lexicon and the counts of tag pairs as Parquet tables in one folder."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyzer, stats
from . import lexicon


def save_model(entries: DataFrame, path: str, pairs: dict[tuple[str, str], float] | None = None) -> None:
    """Writes lexicon and, if given, tag pairs; an older model at path is replaced."""
    spark = entries.sparkSession
    entries.write.mode("overwrite").parquet(f"{path}/lexicon")
    rows = [(a, b, p) for (a, b), p in (pairs or {}).items()]
    spark.createDataFrame(rows, "a string, b string, log_p double").write.mode("overwrite").parquet(f"{path}/pairs")


def kind_of(spark: SparkSession, path: str) -> str:
    """"pairs" for a model with tag pairs, "rules" for one without."""
    return "pairs" if spark.read.parquet(f"{path}/pairs").limit(1).count() else "rules"


def load_model(spark: SparkSession, path: str, dialects: int = ~0) -> analyzer.Model:
    entries = spark.read.parquet(f"{path}/lexicon").where((F.col("dialect") == 0) | (F.col("dialect").bitwiseAND(F.lit(dialects)) != 0))
    built = analyzer.model(entries)
    pairs = {(r.a, r.b): r.log_p for r in spark.read.parquet(f"{path}/pairs").collect()}
    built.pairs = pairs or None
    return built


def morphemes_of(corpus: DataFrame, least: int = 2, certain: float = 0.85) -> DataFrame:
    """form, tag, n, log_p, before: the morphemes of a tagged corpus, each at least `least` times, and for particles and endings whether they stand behind a vowel or a consonant, where `certain` of their places agree (null otherwise)."""
    flat = corpus.select(F.posexplode("morphs").alias("k", "m"), "morphs")
    last = F.right(F.get("morphs", F.col("k") - 1).form, F.lit(1))
    coda = F.when(F.ascii(last).between(0xAC00, 0xD7A3), (F.ascii(last) - 0xAC00) % 28 > 0)
    each = flat.select("m.form", "m.tag", F.when(F.col("k") > 0, coda).alias("closed"))
    counted = each.groupBy("form", "tag").agg(F.count("*").alias("n"), F.avg(F.col("closed").cast("double")).alias("closed")).where(F.col("n") >= least)
    total = corpus.select(F.size("morphs").alias("s")).agg(F.sum("s").alias("all"))
    bound = F.col("tag").startswith("J") | F.col("tag").startswith("E")
    before = F.when(bound & (F.col("closed") >= certain), "consonant").when(bound & (F.col("closed") <= 1 - certain), "vowel")
    return counted.crossJoin(F.broadcast(total)).select("form", "tag", "n", F.log(F.col("n") / F.col("all")).alias("log_p"), before.alias("before"))


def entries_of(morphemes: DataFrame) -> DataFrame:
    """Lexicon entries from morphemes_of(); scores are log probabilities."""
    return morphemes.select(F.col("form").alias("surface"), F.array(F.struct("form", "tag", F.lit(None).cast("int").alias("sense"))).alias("analysis"), F.lit(False).alias("is_rule"), F.col("log_p").alias("score"), F.lit(0).alias("dialect"), F.lit(None).cast("int").alias("sense"))


def with_ids(corpus: DataFrame, morphemes: DataFrame) -> DataFrame:
    """sent_id, word_idx, ids: each word's morphemes as numbers of the lexicon (by frequency, from 0); what it lacks is its tag's number, behind all morphemes."""
    known = stats.numbered(morphemes, F.desc("n"), F.asc("form"), F.asc("tag"))
    tags = stats.numbered(morphemes.select("tag").distinct(), F.asc("tag")).select("tag", (F.col("number") + F.lit(known.count())).alias("tag_id"))
    flat = corpus.select("sent_id", "word_idx", F.posexplode("morphs").alias("k", "m")).select("sent_id", "word_idx", "k", "m.form", "m.tag")
    joined = flat.join(known.select("form", "tag", "number"), ["form", "tag"], "left").join(F.broadcast(tags), "tag", "left")
    return joined.groupBy("sent_id", "word_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("number", "tag_id", F.lit(-1)).alias("id")))), lambda x: x.id).alias("ids"))


def starter_model(spark: SparkSession) -> analyzer.Model:
    return analyzer.model(lexicon.starter(spark))


