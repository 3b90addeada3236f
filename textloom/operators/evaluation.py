"""How well analyses meet gold ones: morpheme scores by longest common subsequence, choice between readings, nouns, and differences of two analyses.

Tables in, tables out: per row first, then one aggregation. Forms are compared after small equivalences (object particles are alike whatever their form, 은/는/ᆫ, 을/를/ᆯ, 아/어 and 여 in endings).
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jamo

NOUNS = ("NNG", "NNP", "NNB", "NR", "NP", "XR")


def normal(form: str, tag: str) -> tuple[str, str]:
    """What a morpheme counts as."""
    tag = tag.split("-")[0]
    form = jamo.join(form)
    if tag == "JKO":
        return "를", tag
    if tag in ("JX", "JKS", "JC", "JKB", "ETM", "ETN", "EP", "EF", "EC"):
        for group in (("은", "는", "ᆫ", "ㄴ"), ("이", "가"), ("과", "와"), ("으로", "로"), ("을", "ᆯ", "ㄹ"), ("음", "ᆷ", "ㅁ")):
            if form in group and (tag.startswith("J") or form not in ("이", "가", "과", "와", "으로", "로")) and not (tag == "ETM" and form == "는"):
                return group[0], tag
        if tag.startswith("E") and form[:1] in "아여았였":
            form = {"아": "어", "여": "어", "았": "었", "였": "었"}[form[0]] + form[1:] if form[:1] else form
    return form, tag


def common(gold: list[tuple[str, str]], found: list[tuple[str, str]]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(found) + 1)
    for g in gold:
        last = 0
        for j, f in enumerate(found, 1):
            keep = row[j]
            row[j] = last + 1 if g == f else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def _pairs(tokens) -> list[tuple[str, str]]:
    return [] if tokens is None else [normal(t["form"], t["tag"]) for t in tokens]


def morph_scores(df: DataFrame, id_col: str, gold_col: str, found_col: str) -> DataFrame:
    """id, common, total, ratio: morphemes in common, and those of both together (common ones once). Two empty analyses have ratio 1."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, g, f in zip(b["id"], b["gold"], b["found"]):
                gold, found = _pairs(g), _pairs(f)
                c = common(gold, found)
                total = len(gold) + len(found) - c
                rows.append((i, c, total, c / total if total else 1.0))
            yield pd.DataFrame(rows, columns=["id", "common", "total", "ratio"])

    return df.select(F.col(id_col).alias("id"), F.col(gold_col).alias("gold"), F.col(found_col).alias("found")).mapInPandas(run, f"id {kind}, common int, total int, ratio double")


def summary(scores: DataFrame) -> DataFrame:
    """micro (over all morphemes), macro (mean of rows), rows."""
    return scores.agg((F.sum("common") / F.sum("total")).alias("micro"), F.avg("ratio").alias("macro"), F.count("*").alias("rows"))


def disambiguation(df: DataFrame, target_col: str, found_col: str) -> DataFrame:
    """accuracy, rows: the share of rows whose analysis has the target morpheme (form and tag)."""
    hit = F.exists(F.col(found_col), lambda t: (t.form == F.col(target_col).form) & (F.split_part(t.tag, F.lit("-"), F.lit(1)) == F.split_part(F.col(target_col).tag, F.lit("-"), F.lit(1))))
    return df.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"), F.count("*").alias("rows"))


def noun_scores(df: DataFrame, golds_col: str, found_col: str) -> DataFrame:
    """precision, recall, f1 of nouns: each noun of a row as often as both sides have it. golds: array<struct<noun, cnt>>; found: tokens."""
    keyed = df.withColumn("row_", F.monotonically_increasing_id())
    gold = keyed.select("row_", F.explode(golds_col).alias("g")).groupBy("row_", F.col("g.noun").alias("noun")).agg(F.sum("g.cnt").alias("want"))
    found = keyed.select("row_", F.explode(F.filter(found_col, lambda t: t.tag.isin(*NOUNS))).alias("t")).groupBy("row_", F.col("t.form").alias("noun")).agg(F.count("*").alias("have"))
    both = gold.join(found, ["row_", "noun"], "full").select(F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("have", F.lit(0)).alias("have"))
    sums = both.agg(F.sum(F.least("want", "have")).alias("hit"), F.sum("want").alias("want"), F.sum("have").alias("have"))
    p, r = F.col("hit") / F.nullif(F.col("have"), F.lit(0)), F.col("hit") / F.nullif(F.col("want"), F.lit(0))
    return sums.select(p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0))).alias("f1"))


def differences(df: DataFrame, id_col: str, left_col: str, right_col: str) -> DataFrame:
    """id, kind (replace, delete, insert), left, right: the stretches in which two analyses of a row differ, as form/TAG texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, left, right = [], [], [], []
            for i, (x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                x, y = ([f"{t['form']}/{t['tag']}" for t in v or []] for v in (x, y))
                for op, a, c, d, e in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    if op != "equal":
                        rows.append(i)
                        kinds.append(op)
                        left.append(" ".join(x[a:c]))
                        right.append(" ".join(y[d:e]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, pa.string()) for v in (kinds, left, right))], names=["id", "kind", "left", "right"])

    return df.select(F.col(id_col).alias("id"), F.col(left_col), F.col(right_col)).mapInArrow(run, f"id {kind}, kind string, left string, right string")
