from pyspark.sql import functions as F

from textloom.__main__ import main
from textloom.operators import analyzer, intervals, stats
from textloom.sources import lexicon, models


def test_models_on_disk(spark, tmp_path):
    corpus = spark.createDataFrame([(1, 0, "나는", [("나", "NP"), ("는", "JX")]), (1, 1, "밥을", [("밥", "NNG"), ("을", "JKO")]), (2, 0, "나를", [("나", "NP"), ("를", "JKO")])], "sent_id int, word_idx int, word string, morphs array<struct<form:string,tag:string>>")
    path = str(tmp_path / "m")
    models.save_model(lexicon.starter(spark), path, analyzer.tag_pairs(corpus))
    assert models.kind_of(spark, path) == "pairs"
    m = models.load_model(spark, path)
    assert m.pairs and len(m.morphs) == len(analyzer.model().morphs)
    models.save_model(lexicon.starter(spark), path)
    assert models.kind_of(spark, path) == "rules" and models.load_model(spark, path).pairs is None
    got = {(r.form, r.tag): (r.n, r.before) for r in models.morphemes_of(corpus, 1).collect()}
    assert got[("나", "NP")] == (2, None) and got[("을", "JKO")] == (1, "consonant") and got[("를", "JKO")] == (1, "vowel")
    assert models.entries_of(models.morphemes_of(corpus, 1)).schema.simpleString() == lexicon.starter(spark).schema.simpleString()
    ids = {(r.sent_id, r.word_idx): r.ids for r in models.with_ids(corpus, models.morphemes_of(corpus, 2)).collect()}
    assert ids[(1, 0)] == [0, -1] and ids[(2, 0)] == [0, -1]


def test_command(spark, tmp_path):
    (tmp_path / "in.txt").write_text("나는 갔다.\n\n책\n", encoding="utf-8")
    main([str(tmp_path / "out"), str(tmp_path / "in.txt")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "나/NP 는/JX 가/VV 었/EP 다/EF ./SF", "책/NNG"]
    main([str(tmp_path / "two"), str(tmp_path / "in.txt"), "--top", "2", "--score"])
    assert all("\t" in r.value for r in spark.read.text(str(tmp_path / "two")).where("value != ''").collect())


def test_samples_and_pruning(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(500)], "k bigint, w double")
    drawn = stats.weighted_sample(df, ["k"], "w", 100).collect()
    assert len({r.k for r in drawn}) == 100 and all(r.w > 0 for r in drawn)
    assert sum(r.w == 4 for r in drawn) > sum(r.w == 1 for r in drawn)
    c = spark.createDataFrame([("ab", 10), ("abc", 10), ("xb", 10), ("xbc", 3)], "form string, n bigint")
    assert {r.form for r in stats.pruned(c).collect()} == {"abc", "xb", "xbc"}
    assert spark.range(1).select(stats.chr_ids(F.lit("ba?"), "ab")).first()[0] == [2, 1, 0]


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 2, 3), (1, 4, 6), (1, 6, 7), (2, 0, 0), (2, 0, 1)], "id int, begin int, end int")
    assert sorted((r.id, r.begin) for r in intervals.overlapping(spans, "id").collect()) == [(1, 2), (1, 4)]
    nodes = spark.createDataFrame([("x", "a", 0, 2), ("x", "b", 2, 3), ("y", "c", 2, 4)], "id string, node string, begin int, end int")
    assert [tuple(r) for r in intervals.edges(nodes, "id", "node").collect()] == [("x", "a", "b")]
    assert intervals.useful(nodes.where("node = 'none'"), spark.createDataFrame([("x", 3)], "id string, size int"), "id").count() == 0
