"""Quality rules with risk-controlled cutoffs.

Each rule scores a document from 0 (bad) to 1 (good) and rejects scores below a cutoff k/GRID. The cutoffs are chosen in each
stratum (language) on the labelled documents, which no rule was fitted to:

* for each cutoff the number of good labelled documents that it rejects gives an exact binomial test of "the rule rejects more
  than alpha / rules of the good documents", and a cutoff is certified if P(Bin(n, alpha / rules) <= rejected) <= delta / (rules * strata).
  The cutoffs of a rule are nested, so testing them from lenient to strict up to the first failure needs no further
  correction (fixed sequence); rules and strata are corrected by Bonferroni. With probability 1 - delta all chosen cutoffs of
  all strata hold their limit, and all rules together falsely reject at most alpha of a stratum;
* the gain of a cutoff is the share of bad documents that it rejects less the share of good ones. Of the certified cutoffs the
  most lenient is used whose gain is within SLACK of the largest; a rule whose largest gain is under LEAST_GAIN is off in that
  stratum, so that no good document is lost to a rule that finds no bad ones.

Defined cases: a null or blank text is rejected as "empty"; a null stratum is the stratum "" with cutoffs of its own; labels with
a null doc_id or quality are ignored, as are those of unknown documents; of several labels of a document all count; rows
that repeat are judged each; a row with a null doc_id is judged by its text. Without labels nothing but empty texts is
rejected. Any number of strata is worked on, each by itself. Extra columns stay and take no part, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, sized, text_or_empty, written

GRID = 40
#: Of the good documents of a stratum, for all rules together.
ALPHA = 0.06
DELTA = 0.05
SLACK = 0.01
LEAST_GAIN = 0.03
SYMBOLS = r"[#$%&*|<>{}^~=@_\\]"


def rules(text: Column) -> dict[str, Column]:
    """Name -> score from 0 to 1. Built-in expressions only."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    gaps = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.size(lines)
    return {
        "symbols": (chars - F.regexp_count(text, F.lit(SYMBOLS))) / chars,
        "digits": (chars - F.regexp_count(text, F.lit("[0-9]"))) / chars,
        "lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "word_length": F.least(F.lit(1.0), gaps * 9 / chars),
    }


def levels(df: DataFrame, text_col: str, stratum_col: str, name: str) -> DataFrame:
    """df with the struct `name`: stratum, whether the text is blank, and each rule's level floor(score * GRID)."""
    text = text_or_empty(F.col(text_col))
    scored = {k: F.floor(v * GRID).cast("int") for k, v in rules(text).items()}
    return df.withColumn(
        name,
        F.struct(
            F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
            (~F.rlike(text, F.lit(r"\S"))).alias("empty"),
            *[v.alias(k) for k, v in scored.items()],
        ),
    )


def _log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), exactly: the tail that doesn't hold the mean is summed outwards until its terms no longer count."""
    upper = k >= n * p
    j = k + 1 if upper else k
    if j > n:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    # terms as multiples of the first; outwards from the mean they only fall
    terms, term = [], 1.0
    while 0 <= j <= n and term > 1e-18:
        terms.append(term)
        term *= (n - j) * p / ((j + 1) * (1 - p)) if upper else j * (1 - p) / ((n - j + 1) * p)
        j += 1 if upper else -1
    log = min(0.0, first + math.log(math.fsum(terms)))
    return math.log1p(-math.exp(log)) if upper else log


def _chosen(alpha: float, share: float):
    """The cutoffs of one stratum from its counts by rule and level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": [pdf["stratum"].iloc[0]], **{r: [0] for r in rules_names()}}
        for rule, at in pdf.groupby("rule"):
            at = {r.level: (r.good, r.bad) for r in at.itertuples()}
            goods, bads = sum(g for g, _ in at.values()), sum(b for _, b in at.values())
            good, bad, gains = 0, 0, {}
            for k in range(1, GRID + 1):
                good, bad = good + at.get(k - 1, (0, 0))[0], bad + at.get(k - 1, (0, 0))[1]
                if not goods or not bads or _log_binomial_cdf(good, goods, alpha) > share:
                    break
                gains[k] = bad / bads - good / goods
            if gains and (most := max(gains.values())) >= LEAST_GAIN:
                out[rule] = [min(k for k, g in gains.items() if g >= most - SLACK)]
        return pd.DataFrame(out)

    return run


def cutoffs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and for each rule the cutoff level k (reject below k / GRID; 0: the rule is off), for the strata of labelled documents. The labelled documents are found first and only these are scored, while the labels are
    few enough to broadcast; beyond that, levels are joined, so that no text is shuffled."""
    names = list(rules_names())
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").alias("quality")).where("id is not null and quality is not null")
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    small = sized(known, n := known.count())
    if small is not known:
        scored = levels(plain.join(small, "id"), "text", "lang", "q")
    else:
        scored = levels(plain, "text", "lang", "q").select("id", "q").join(known, "id")
    flat = scored.where(~F.col("q.empty")).select("quality", "q.stratum", F.explode(F.create_map(*[x for k in names for x in (F.lit(k), F.col(f"q.{k}"))])).alias("rule", "level"))
    counted = written(flat.groupBy("stratum", "rule", "level").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")), "levels")
    strata = counted.select("stratum").distinct().count() if n else 0
    share = math.log(delta / (len(names) * max(1, strata)))
    return written(counted.groupBy("stratum").applyInPandas(_chosen(alpha / len(names), share), "stratum string, " + ", ".join(f"{r} int" for r in names)), "cutoffs")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the levels, and the names of the rules that reject the row, in alphabetic order."""
    chosen = cutoffs(docs, labels, id_col, text_col, stratum_col, alpha, delta)
    q, failed, stratum, cuts = free_names(docs, "levels", "failed", "stratum", "cutoffs")
    names = sorted(rules_names())
    packed = chosen.select(F.col("stratum").alias(stratum), F.struct(*names).alias(cuts))
    leveled = levels(docs, text_col, stratum_col, q).withColumn(stratum, F.col(f"{q}.stratum")).join(sized(packed, packed.count(), 64), stratum, "left")
    tests = [F.when(F.col(f"{q}.empty"), F.lit("empty")), *[F.when(~F.col(f"{q}.empty") & (F.col(f"{q}.{r}") < F.coalesce(F.col(f"{cuts}.{r}"), F.lit(0))), F.lit(r)) for r in names]]
    return leveled.withColumn(failed, F.array_compact(F.array(*tests))), q, failed


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, stratum, keep, failed (rule names, comma-separated) for every row."""
    df, q, failed = judged(docs, labels, id_col, **options)
    return df.select(F.col(id_col).alias("doc_id"), F.col(f"{q}.stratum").alias("stratum"), (F.size(failed) == 0).alias("keep"), F.array_join(failed, ",").alias("failed"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that no rule rejects, with their columns as they came."""
    df, _, failed = judged(docs, labels, **options)
    return df.where(F.size(failed) == 0).select(docs.columns)


def _sql(docs: str) -> str:
    """Common table expressions up to chosen(stratum, rule, k) and leveled, for DuckDB, over a relation docs."""
    names = list(rules_names())
    union = " UNION ALL ".join(f"SELECT quality, stratum, '{r}' AS rule, {r} AS level FROM labelled" for r in names)
    return f"""
    texts AS (SELECT *, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM {docs}),
    sized AS (SELECT *, CAST(greatest(length(t), 1) AS DOUBLE) AS chars, string_split(t, chr(10)) AS ls FROM texts),
    leveled AS (SELECT * EXCLUDE (t, chars, ls),
        NOT regexp_matches(t, '\\S') AS blank,
        CAST(floor((chars - len(regexp_extract_all(t, '{SYMBOLS}'))) / chars * {GRID}) AS INT) AS symbols,
        CAST(floor((chars - len(regexp_extract_all(t, '[0-9]'))) / chars * {GRID}) AS INT) AS digits,
        CAST(floor(len(list_distinct(ls)) / CAST(len(ls) AS DOUBLE) * {GRID}) AS INT) AS lines,
        CAST(floor(least(1.0::DOUBLE, (length(t) - length(replace(t, ' ', '')) + len(ls)) * 9 / chars) * {GRID}) AS INT) AS word_length
        FROM sized),
    labelled AS (SELECT l.quality, d.* FROM labels l JOIN leveled d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND NOT d.blank),
    flat AS ({union}),
    totals AS (SELECT stratum, rule, count(*) FILTER (quality = 1) AS goods, count(*) FILTER (quality = 0) AS bads FROM flat GROUP BY ALL),
    tried AS (SELECT x.stratum, x.rule, k, any_value(goods) AS goods, any_value(bads) AS bads,
        count(*) FILTER (quality = 1 AND level < k) AS good, count(*) FILTER (quality = 0 AND level < k) AS bad
        FROM totals x JOIN flat f ON x.stratum = f.stratum AND x.rule = f.rule CROSS JOIN (SELECT unnest(range(1, {GRID} + 1)) AS k) GROUP BY x.stratum, x.rule, k),
    certified AS (SELECT *, bad / CAST(bads AS DOUBLE) - good / CAST(goods AS DOUBLE) AS gain FROM tried
        WHERE goods > 0 AND bads > 0 AND list_sum(list_transform(range(0, good + 1), lambda j: exp(lgamma(goods + 1) - lgamma(j + 1) - lgamma(goods - j + 1) + j * ln({ALPHA / len(names)}) + (goods - j) * ln(1 - {ALPHA / len(names)}))))
            <= {DELTA} / ({len(names)} * (SELECT count(DISTINCT stratum) FROM totals))),
    gained AS (SELECT *, max(gain) OVER (PARTITION BY stratum, rule) AS most FROM certified),
    chosen AS (SELECT stratum, rule, min(k) AS k FROM gained WHERE most >= {LEAST_GAIN}::DOUBLE AND gain >= most - {SLACK}::DOUBLE GROUP BY stratum, rule)"""


def rules_names() -> tuple[str, ...]:
    return ("symbols", "digits", "lines", "word_length")


def _failed_sql() -> str:
    return "concat_ws(',', CASE WHEN blank THEN 'empty' END, " + ", ".join(f"CASE WHEN NOT blank AND {r} < coalesce((SELECT c.k FROM chosen c WHERE c.stratum = leveled.stratum AND c.rule = '{r}'), 0) THEN '{r}' END" for r in sorted(rules_names())) + ")"


ORACLE = f"WITH {_sql('documents')} SELECT doc_id, stratum, failed = '' AS keep, failed FROM (SELECT doc_id, stratum, {_failed_sql()} AS failed FROM leveled)"
