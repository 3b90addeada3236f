"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in tokens. The total is the largest that the target weights allow (no source is used
up before its share), or the one asked for; a source's budget is its share of it, rounded down. Within a source, each length gives the same proportion of its documents first; a bounded-knapsack program over the
documents left then finds the largest sum that fits the rest. The rest that is left to the program is SLACK tokens at first and grows until the budget is met exactly, or until the program has all of it, so the sum is always the
largest there is. Which documents of a length are taken is decided by a seeded hash of id and text: the smallest ones, cut by one threshold for each source
and length, so that no text is shuffled. Thresholds come from counts by intervals of the hash; only the interval that holds the threshold is looked at row by row.

Weights: {source: weight}, normalised. Without them a source weighs its tokens ** TEMPERATURE, which flattens the mixture. Tokens are runs of
anything but white space unless a tokenizer file is given (Hugging Face JSON, read on every executor). Sources are worked on apart from each other, any number of them.

Defined cases: a null source is the source ""; null or empty texts have length 0, take no budget and are all kept, if their source has a weight; sources without a weight are left out, weights for
sources without documents take no share; rows that repeat are as many documents: of rows equal in id, text and source as many stay as the budget takes; null ids are told apart by their text; an empty table gives an empty one. Extra columns stay and take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, rank_hash, sized, text_or_empty, written

TEMPERATURE = 0.7
SLACK = 20_000
SEED = 17
#: Intervals of the hash that documents of one source and length are counted in: 2 to this power.
INTERVALS = 12


def length(text_col: str = "text", tokenizer: str | None = None) -> Column:
    if tokenizer is None:
        return F.regexp_count(text_or_empty(text_col), F.lit(r"[^ \n\t\r\f]+"))

    @F.pandas_udf("int")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch(texts.tolist(), add_special_tokens=False)], dtype="int32")

    return tokens(text_or_empty(text_col))


def closed(counts: dict[int, int], rest: int) -> tuple[int, dict[int, int]]:
    """Bounded knapsack: the largest sum of at most rest, and what makes it. Bit j of reach says that j tokens can be made, made[j] by which bundle first."""
    bundles = []
    for n in sorted(counts, reverse=True):
        left, k = min(counts[n], rest // n), 1
        while left > 0:
            bundles.append((n, min(k, left)))
            left -= min(k, left)
            k *= 2
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    made = np.full(rest + 1, -1, np.int32)
    for i, (n, k) in enumerate(bundles):
        if reach[rest]:
            break
        v = n * k
        new = np.flatnonzero(reach[: len(reach) - v] & ~reach[v:]) + v
        reach[new] = True
        made[new] = i
    best = j = int(np.flatnonzero(reach)[-1])
    take: dict[int, int] = {}
    while j:
        n, k = bundles[made[j]]
        take[n] = take.get(n, 0) + k
        j -= n * k
    return best, take


def fitted(counts: dict[int, int], budget: int, slack: int = SLACK) -> dict[int, int]:
    """length -> documents to take, at most counts, with the largest total of at most budget."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total or not counts:
        return counts
    unit = int(np.gcd.reduce(np.array(list(counts), np.int64)))
    counts, budget, total, slack = {n // unit: c for n, c in counts.items()}, budget // unit, total // unit, max(1, slack // unit)
    while True:
        share = max(0, budget - slack)
        take = {n: c * share // total for n, c in counts.items()}
        rest = budget - sum(n * c for n, c in take.items())
        if share:
            for n in sorted(counts, key=lambda n: (-(counts[n] * share % total), -n)):
                if take[n] < counts[n] and rest - n > slack:
                    take[n] += 1
                    rest -= n
        best, more = closed({n: counts[n] - take[n] for n in counts}, rest)
        if best == rest or not share:
            out = {n: take[n] + more.get(n, 0) for n in counts}
            return {n * unit: c for n, c in out.items() if c}
        slack *= 4


def _planned(pdf: pd.DataFrame) -> pd.DataFrame:
    """source, tokens, take, all of one source, from its lengths, their counts and its budget (null: it has no weight)."""
    source, budget = pdf["source"].iloc[0], pdf["budget"].iloc[0]
    counts = dict(zip(pdf["tokens"].tolist(), pdf["count"].tolist()))
    take = {} if pd.isna(budget) else {**fitted(counts, int(budget)), **({0: counts[0]} if 0 in counts else {})}
    rows = [(source, n, c, c == counts[n]) for n, c in take.items()]
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=kind) for i, (k, kind) in enumerate((("source", "object"), ("tokens", "int32"), ("take", "int64"), ("all", "bool")))})


def budgets(counts: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, budget of the sources that have a weight, from counts(source, tokens, count)."""
    spark = counts.sparkSession
    sums = counts.groupBy("source").agg(F.sum(F.col("tokens") * F.col("count")).alias("sum"))
    if weights is None:
        weighed = sums.withColumn("weight", F.when(F.col("sum") > 0, F.pow(F.col("sum").cast("double"), F.lit(temperature))).otherwise(F.lit(1.0)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, weight double")
        weighed = sums.join(F.broadcast(given), "source")
    weighed = written(weighed, "weights")
    # decimals add up to the same whatever their order, so that budgets don't depend on how rows are spread
    whole = float(weighed.where("sum > 0").agg(F.coalesce(F.sum(F.col("weight").cast("decimal(28,9)")), F.lit(0))).first()[0])
    if not whole:
        return weighed.select("source", F.lit(0).cast("bigint").alias("budget"))
    most = total if total is not None else weighed.where("sum > 0").agg(F.min(F.floor(F.col("sum") * F.lit(whole) / F.col("weight")))).first()[0]
    return weighed.select("source", F.least("sum", F.floor(F.lit(float(most)) * F.col("weight") / F.lit(whole))).cast("bigint").alias("budget"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, tokenizer: str | None = None, temperature: float = TEMPERATURE, lengths: bool = False) -> DataFrame:
    """The chosen rows of docs, with their columns as they came; with lengths just id, source and tokens of them."""
    source, tokens, rank, cut, ties, nth = free_names(docs, "source_", "tokens", "rank", "cut", "ties", "nth")
    tagged = docs.withColumns({source: F.coalesce(F.col(source_col).cast("string"), F.lit("")), tokens: length(text_col, tokenizer), rank: rank_hash(F.col(id_col).cast("string"), F.col(text_col).cast("string"), seed=seed)})
    key = ["source", "tokens"]
    narrow = written(tagged.select(F.col(source).alias("source"), F.col(tokens).alias("tokens"), F.col(rank).alias("rank"), F.shiftrightunsigned(F.col(rank).bitwiseXOR(F.lit(-(2**63))), 64 - INTERVALS).cast("int").alias("interval")), "ranks")
    counts = written(narrow.groupBy(*key).count(), "lengths")
    budget = written(budgets(counts, weights, total, temperature), "budgets")
    plan = written(counts.join(sized(budget, budget.count(), 32), "source", "left").groupBy("source").applyInPandas(_planned, "source string, tokens int, take bigint, all boolean"), "plan")
    n = plan.count()
    part = sized(plan.where("not all").select(*key, "take"), n, 32)
    # the interval in which a length's threshold lies, then the threshold: the hash of the last document taken
    by_interval = narrow.join(part, key).groupBy(*key, "take", "interval").count()
    upto = F.sum("count").over(Window.partitionBy(*key).orderBy("interval"))
    holds = written(by_interval.withColumn("upto", upto).where("upto >= take and upto - count < take").select(*key, "interval", (F.col("take") - F.col("upto") + F.col("count")).alias("left")), "intervals")
    inside = narrow.join(sized(holds, n, 32), [*key, "interval"]).groupBy(*key, "left", "rank").count()
    upto = F.sum("count").over(Window.partitionBy(*key).orderBy("rank"))
    cuts = inside.withColumn("upto", upto).where("upto >= left and upto - count < left").select(*key, F.col("rank").alias("cut"), F.when(F.col("upto") > F.col("left"), F.col("left") - F.col("upto") + F.col("count")).alias("ties"))
    limits = written(plan.where("all").select(*key, F.lit(None).cast("bigint").alias("cut"), F.lit(None).cast("bigint").alias("ties")).unionByName(cuts), "limits")
    limits = limits.select(F.col("source").alias(source), F.col("tokens").alias(tokens), F.col("cut").alias(cut), F.col("ties").alias(ties))
    joined = tagged.join(sized(limits, n, 32), [source, tokens])
    clear = joined.where(F.col(cut).isNull() | (F.col(rank) < F.col(cut)) | ((F.col(rank) == F.col(cut)) & F.col(ties).isNull()))
    out = clear.select(*[F.col(c) for c in docs.columns], source, tokens)
    if limits.where(F.col(ties).isNotNull()).limit(1).count():  # rows that repeat at a threshold: only these are shuffled
        same = joined.where((F.col(rank) == F.col(cut)) & F.col(ties).isNotNull()).withColumn(nth, F.row_number().over(Window.partitionBy(source, tokens).orderBy(rank)))
        out = out.unionByName(same.where(F.col(nth) <= F.col(ties)).select(out.columns))
    if lengths:
        return out.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).alias("n_tokens"))
    return out.select(docs.columns)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens of every chosen document."""
    return mixed(docs, lengths=True, **options)
