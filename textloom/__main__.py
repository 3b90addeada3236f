"""Analyses text files, line by line: python -m textloom [--top N] [--score] [--model DIR] OUT FILE...  (OUT: a folder of text files, one line `form/TAG ...` for each line and analysis)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analyzer
from .sources import models


def lines(df: DataFrame, model: analyzer.Model | None = None, top: int = 1, score: bool = False) -> DataFrame:
    """value: the written analyses of value."""
    numbered = df.select(F.monotonically_increasing_id().alias("n"), "value")
    found = analyzer.analyze(numbered, "n", "value", model, analyzer.Options(top_n=top))
    text = F.array_join(F.transform("tokens", lambda t: F.concat(t.form, F.lit("/"), t.tag)), " ")
    return found.select(F.concat_ws("\t", text, F.round("score", 4).cast("string")).alias("value") if score else text.alias("value"))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    p.add_argument("out")
    p.add_argument("files", nargs="+")
    p.add_argument("--top", type=int, default=1)
    p.add_argument("--score", action="store_true")
    p.add_argument("--model")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    lines(spark.read.text(a.files), models.load_model(spark, a.model) if a.model else None, a.top, a.score).write.text(a.out)


if __name__ == "__main__":
    main()
