"""Subwords, evaluation, lexicon changes, dictionary files, and streams."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import analyzer, dictionary, evaluation, subword
from textloom.sources import lexicon
from textloom.streaming import analysis

VOCAB = subword.with_bytes([("한국", None, "word", -3.0), ("한", None, "word", -4.0), ("국", None, "piece", -4.0), ("어", None, "piece", -3.0), ("the", None, "word", -2.0), ("th", None, "word", -4.0), ("e", None, "piece", -3.0), ("<s>", None, "special", 0.0), ("가", "VV", "morph", -2.0), ("었", "EP", "morph", -2.0), ("다", "EF", "morph", -2.0)])


def test_subwords_take_the_best_cut_and_come_back():
    s = subword.Subword(VOCAB)
    name = lambda ids: [VOCAB[i][0] for i in ids]
    assert name(s.encode("한국어 the")) == ["한국", "어", "the"] and name(s.cut("한국")) == ["한국"]
    r = random.Random(1)
    for text in ["", " ", "한국어", "a b", "the  the", " the ", "한 국", "x\n\ny", "é漢 <s>", "the x the", "z the"] + ["".join(r.choices("the한국어 \tx漢", k=12)) for _ in range(300)]:
        assert s.decode(s.encode(text)) == text
    assert s.encode(None) is None and s.decode(None) is None
    assert subword.Subword.from_json(s.to_json()).encode("한국어 x") == s.encode("한국어 x")
    morphs = s.encode_morphs([("가", "VV"), ("었", "EP"), ("다", "EF")])
    assert s.decode(morphs) == "갔다"
    with pytest.raises(ValueError):
        s.decode([99999])
    assert s.decode([99999], errors=False) == ""
    for bad in ([*VOCAB, VOCAB[-1]], VOCAB[1:], [*VOCAB, ("x", None, "what", 0.0)], [*VOCAB, ("x", None, "word", float("nan"))]):
        with pytest.raises(ValueError):
            subword.Subword(bad)


def test_subword_tables(spark):
    s = subword.vocabulary(spark.createDataFrame([(i, *r) for i, r in enumerate(VOCAB)], "id int, form string, tag string, kind string, lprob double"))
    df = spark.createDataFrame([(1, "한국어 the x"), (2, None), (3, "")], "k bigint, t string")
    again = subword.decode(subword.encode(df, "k", "t", s), "id", "ids", s).collect()
    assert sorted(map(tuple, again)) == [(1, "한국어 the x"), (2, None), (3, "")]


def test_evaluation(spark):
    token = "array<struct<form:string,tag:string>>"
    gold = [("나", "NP"), ("은", "JX"), ("가", "VV"), ("았", "EP"), ("다", "EF")]
    found = [("나", "NP"), ("는", "JX"), ("가", "VV"), ("었", "EP"), ("네", "EF")]
    df = spark.createDataFrame([(1, gold, found), (2, [], []), (3, None, found[:1])], f"id int, g {token}, f {token}")
    scores = evaluation.morph_scores(df, "id", "g", "f")
    assert sorted((r.id, r.common, r.total) for r in scores.collect()) == [(1, 4, 6), (2, 0, 0), (3, 0, 1)]
    total = evaluation.summary(scores).first()
    assert total.micro == pytest.approx(4 / 7) and total.macro == pytest.approx((4 / 6 + 1 + 0) / 3) and total.rows == 3
    assert [(r.id, r.kind, r.left, r.right) for r in evaluation.differences(df.where("id = 1"), "id", "g", "f").collect()] == [(1, "replace", "은/JX", "는/JX"), (1, "replace", "았/EP 다/EF", "었/EP 네/EF")]
    target = df.withColumn("t", F.struct(F.lit("가").alias("form"), F.lit("VV-I").alias("tag")))
    assert evaluation.disambiguation(target, "t", "f").first() == (pytest.approx(1 / 3), 3)
    nouns = spark.createDataFrame([([("책", 2), ("밥", 1)], [("책", "NNG"), ("물", "NNG"), ("을", "JKO")])], f"g array<struct<noun:string,cnt:int>>, f {token}")
    r = evaluation.noun_scores(nouns, "g", "f").first()
    assert (r.precision, r.recall) == (pytest.approx(1 / 2), pytest.approx(1 / 3))


def test_lexicon_changes(spark):
    base = lexicon.starter(spark)
    one, new = dictionary.add_word(base, "뷁", "NNG", -3.0)
    assert new and dictionary.add_word(one, "뷁", "NNG")[1] is False
    two = dictionary.add_alias(one, "핵교", "학교", "NNG", -1.0)
    three = dictionary.add_analysed(two, "뭐라카노", [("뭐", "NP"), ("라고", "JKQ"), ("하", "VV"), ("노", "EF")], -2.0)
    four = dictionary.add_rule(three, "EC", lambda c: F.regexp_replace(c, "고$", "구"), -1.0)
    with pytest.raises(ValueError):
        dictionary.add_alias(base, "x", "없는말", "NNG")
    with pytest.raises(ValueError):
        dictionary.add_analysed(base, "x", [])
    m = analyzer.model(four)
    read = lambda t: [f"{x.form}/{x.tag}" for x in analyzer.Analyzer(m, analyzer.Options()).analyze(t)[0][0]]
    assert read("뷁이 좋다")[0] == "뷁/NNG" and read("핵교에")[0] == "학교/NNG" and read("뭐라카노")[:2] == ["뭐/NP", "라고/JKQ"] and "고/EC" in read("밥을 먹구")
    blocked = spark.createDataFrame([("학교", "NNG")], "form string, tag string")
    assert dictionary.without(four, blocked).where("surface IN ('학교', '핵교')").count() == 0
    assert dictionary.union(base, base).count() == base.count()
    docs = spark.createDataFrame([(" ".join(["뷁뷁은", "뷁뷁이", "뷁뷁을", "학교가", "학교는"] * 30),)], "text string")
    known = {r.form for r in dictionary.extract_words(docs, least=5, least_score=0.01, model=analyzer.model()).collect()}
    assert "뷁뷁" in known and "학교" not in known and "학교가" not in known


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.dict").write_text("# remark\n학교\tNNG\t-3.5\n갔다\t가/VV + 었/EP + 다/EF\t-1\n혼저\t어서/MAG\t0\t<jeju>\t.2\t#note\n구$\t고/EC\t-2\n", encoding="utf-8")
    rows = {r.surface: r for r in lexicon.read_dictionary(spark, str(tmp_path / "d.dict")).collect()}
    assert rows["학교"].score == -3.5 and [(a.form, a.tag) for a in rows["갔다"].analysis] == [("가", "VV"), ("었", "EP"), ("다", "EF")] and rows["혼저"].dialect == 32 and rows["혼저"].sense == 2 and rows["구"].is_rule
    assert lexicon.read_dictionary(spark, str(tmp_path / "d.dict"), 0).count() == 3
    lexicon.write_dictionary(lexicon.read_dictionary(spark, str(tmp_path / "d.dict")), str(tmp_path / "out"))
    assert sorted(map(str, lexicon.read_dictionary(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.values()))
    for bad in ("x", "x\tNOPE", "x\tNNG\tnumber", "x\tNNG\t0\t<nowhere>"):
        with pytest.raises(ValueError):
            lexicon.parse_line(bad, 3)
    (tmp_path / "c.txt").write_text("나는\t나\tNP\t는\tJX\n간다\t가\tVV\tᆫ다\tEF\n\n밥\t밥\tNNG\n", encoding="utf-8")
    got = sorted((r.sent_id, r.word_idx, r.word, len(r.morphs)) for r in lexicon.read_tagged(spark, str(tmp_path / "c.txt")).collect())
    assert got == [(0, 0, "나는", 2), (0, 1, "간다", 2), (1, 0, "밥", 1)]
    (tmp_path / "e.tsv").write_text("나는 간다\t나/NP 는/JX 가__2/VV ᆫ다/EF\n", encoding="utf-8")
    e = lexicon.read_evaluation(spark, str(tmp_path / "e.tsv")).first()
    assert [(g.form, g.sense, g.tag) for g in e.gold] == [("나", None, "NP"), ("는", None, "JX"), ("가", 2, "VV"), ("ᆫ다", None, "EF")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "나는 갔다."), (2, None)], "k bigint, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k bigint, t string").parquet(str(tmp_path / "in"))
    q = analysis.analyzed(stream, "k", "t").writeStream.format("memory").queryName("analysed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, len(r.tokens)) for r in spark.table("analysed").collect()) == [(1, 6), (2, 0)]
    events = spark.sql("SELECT timestamp'2024-01-01 00:05:00' AS ts, 'a' AS k, 1.5 AS v UNION ALL SELECT timestamp'2024-01-01 00:07:00', 'a', 2.0 UNION ALL SELECT timestamp'2024-01-01 00:15:00', 'a', 1.0")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = analysis.windowed_counts(stream, "ts", "k", "v").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, float(r.total)) for r in spark.table("counts").collect()) == [(1, 1.0), (2, 3.5)]
