import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import chars
from textloom.operators import similarity, stats

FIRST = (
    "자, 너 오늘 하루 뭐 했니? 난 오늘 하루가 좀 단순했지. 음 뭐 했는데? "
    "어제는 어제 학생이, 응. 그 학생인데, 음. 되게 재미있게 생겼다, 음. 되게 웃으면 인형같이 생겼어."
)


def brute_substrings(text, least, shortest, longest):
    counts = {}
    for s in text.split(" "):
        for a in range(len(s)):
            for k in range(shortest, min(longest, len(s) - a) + 1):
                counts[s[a : a + k]] = counts.get(s[a : a + k], 0) + 1
    kept = {s: n for s, n in counts.items() if n >= least}
    kept = {s: n for s, n in kept.items() if not (len(s) >= 5 and any(len(s) % p == 0 and s[:p] * (len(s) // p) == s for p in range(1, len(s) // 3 + 1)))}
    return {s: n for s, n in kept.items() if not any(m == n and len(t) == len(s) + 1 and s in (t[1:], t[:-1]) for t, m in kept.items())}


def test_substrings_are_those_of_brute_force(spark):
    rows = [(1, FIRST), (2, "ababab ababab xyxyxyxy xyxyxyxy"), (3, None), (4, "")]
    got = {}
    for r in stats.substrings(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect():
        got.setdefault(r.id, {})[r.substring] = r.n
    assert got == {i: b for i, t in rows if t and (b := brute_substrings(t, 2, 2, 32))}


def test_entropies_and_cohesions(spark):
    words = spark.createDataFrame([("abc", 6), ("abd", 3), ("ab", 1), ("xab", 2)], "word string, n bigint")
    got = {r.form: r for r in stats.word_candidates(words, least=1, longest=3, least_score=-1).collect()}
    ab = got["ab"]
    assert ab.n == 12
    p = {"c": 6 / 12, "d": 3 / 12, "$": 3 / 12}
    assert ab.right_entropy == pytest.approx(sum(q * (math.log(stats.DEFAULT_PERPLEXITY) - math.log(q)) if c == "$" else -q * math.log(q) for c, q in p.items()))
    assert ab.left_cohesion == pytest.approx(1.0) and got["abc"].left_cohesion == pytest.approx((6 / 12) ** 0.5)


def test_kneser_ney_sums_to_one(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choices("a b c d e f g".split(), [9, 5, 3, 2, 1, 1, 1], k=30))) for i in range(40)], "id bigint, t string")
    high, context, lower = stats.kneser_ney(stats.token_pairs(docs, "id", "t"))
    p = {(x.x, x.y): math.exp(x.log_p) for x in high.collect()}
    gamma = {x.x: math.exp(x.log_gamma) for x in context.collect()}
    low = {x.y: math.exp(x.log_p) for x in lower.collect()}
    assert sum(low.values()) == pytest.approx(1)
    for x in gamma:
        assert sum(p.get((x, y), gamma[x] * low[y]) for y in low) == pytest.approx(1)
    scored = stats.kn_scores(spark.createDataFrame([(1, "a b zz a"), (2, None)], "id bigint, t string"), "id", "t", (high, context, lower)).collect()
    assert [(s.id, s.n_pairs) for s in scored] == [(1, 3)]
    assert scored[0].log_prob == pytest.approx(math.log(p.get(("a", "b"), gamma["a"] * low["b"])) - 100 + math.log(low["a"]))


def test_positions(spark):
    docs = spark.createDataFrame([(1, "a bb\r\n\r\nc\x0bd e"), (2, ""), (3, None)], "id bigint, t string")
    got = [(r.word_position, r.line_number, r.begin, r.form) for r in stats.words_and_lines(docs, "id", "t").orderBy("word_position").collect()]
    assert got == [(0, 0, 0, "a"), (1, 0, 2, "bb"), (2, 2, 8, "c"), (3, 3, 10, "d"), (4, 4, 12, "e")]


def test_hangul_round_trip(spark):
    from textloom.functions.hangul import normalize_hangul

    texts = ["한국어 값 닭이", "ㅋㅋ", "a", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chars.join_hangul(normalize_hangul(F.col("t"))).alias("again"), chars.repeated(F.col("t")).alias("r")).collect():
        assert r.again == r.t and not r.r
    assert spark.range(1).select(chars.repeated(F.lit("ababab")).alias("x"), chars.repeated(F.lit("abab")).alias("y")).first() == (True, False)


def test_similar_vectors_are_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)
    got = similarity.most_similar(df, df.where("id % 10 = 3"), "id", "v", 5).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(3, 60, 10):
        want = sorted((-float(unit[q] @ unit[i]), i) for i in range(60) if i != q)[:5]
        mine = [(r.id, r.similarity) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert [i for i, _ in mine] == [i for _, i in want] and [s for _, s in mine] == pytest.approx([-s for s, _ in want])
    assert similarity.most_similar(df.where("id < 0"), df, "id", "v").count() == 0
    pair = df.where("id = 3").select(F.col("v").alias("a")).crossJoin(df.where("id = 101").select(F.col("v").alias("b")))
    assert pair.select(similarity.cosine(F.col("a"), F.col("b"))).first()[0] is None
    words = spark.createDataFrame([(1, [1.0, 0.0], 0.5), (2, [0.0, 1.0], 0.0)], "id bigint, v array<double>, b double")
    contexts = spark.createDataFrame([(9, [2.0, 1.0])], "id bigint, v array<double>")
    assert [(r.rank, r.id, r.score) for r in similarity.predicted(contexts, words, "id", "v", "b").orderBy("rank").collect()] == [(1, 1, 2.5), (2, 2, 1.0)]
