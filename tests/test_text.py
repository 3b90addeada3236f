from pyspark.sql import functions as F

from textloom.functions import hangul


def test_hangul(spark):
    df = spark.createDataFrame([("한국",), ("나무",), ("abc",), ("",)], "t string")
    rows = {r.t: (r.n, r.c) for r in df.select("t", hangul.normalize_hangul(F.col("t")).alias("n"), hangul.has_coda(F.col("t")).alias("c")).collect()}
    assert rows["한국"] == ("하\u11ab구\u11a8", True)
    assert rows["나무"] == ("나무", False)
    assert rows["abc"][0] == "abc" and rows[""][0] == ""
