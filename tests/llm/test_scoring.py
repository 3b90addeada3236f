"""op4 against brute force: every shard boundary, block boundary, own row and repeated row."""

import math
import random

import numpy as np
import pytest

from textloom.llm import infinigram
from textloom.llm.common import words


def test_suffix_search_is_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(10):
        docs = [rng.integers(1, 4, rng.integers(1, 40)).astype(np.uint64) for _ in range(8)]
        docs.append(np.concatenate([docs[0], docs[1]]))
        shard = infinigram.indexed(*infinigram.joined(docs))
        x = shard.x.tolist()
        assert shard.order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        codes, ends = infinigram.joined([rng.integers(1, 5, 30).astype(np.uint64), docs[3]])
        own = infinigram.indexed(codes, ends)
        starts = own.order[own.marks :]
        most = ends[np.searchsorted(ends, starts)] - starts
        depth, low, high = shard.narrowed(own.run, infinigram.numbers(shard, *np.unique(codes, return_inverse=True)), starts, most)
        for k, start in enumerate(starts):
            q = codes[start : start + most[k]].tolist()
            counts = [sum(d[a : a + m].tolist() == q[:m] for d in docs for a in range(len(d) - m + 1)) for m in range(1, len(q) + 1)]
            found = [c for c in counts if c]
            assert depth[k] == len(found) and (not found or high[k] - low[k] == found[-1])


def expected(q: list[str], others: list[list[str]]) -> tuple[float, list[int], int]:
    """The definition, word by word, over all substrings of all other documents."""
    counts: dict[tuple, int] = {}
    for w in others:
        for x in range(len(w)):
            for y in range(x + 1, len(w) + 1):
                counts[tuple(w[x:y])] = counts.get(tuple(w[x:y]), 0) + 1
    n, log, contexts = sum(map(len, others)), 0.0, []
    for i, w in enumerate(q):
        k = 0
        while k < i and counts.get(tuple(q[i - k - 1 : i]), 0):
            k += 1
        p = (counts.get((w,), 0) + 1 / (n + 1)) / (n + 1)
        for level in sorted({min(k, 1), k} - {0}):
            p = (counts.get(tuple(q[i - level : i + 1]), 0) + p) / (counts[tuple(q[i - level : i])] + 1)
        log += math.log(p)
        contexts.append(k)
    return log, contexts, sum((w,) not in counts for w in q)


def same(got, q, others):
    log, contexts, unseen = expected(q, others)
    assert got.n_words == len(q) and got.unseen == unseen
    assert got.log_prob == (pytest.approx(log, rel=1e-9) if q else None)
    assert got.longest_context == (max(contexts) if q else None)
    assert not q or got.mean_context == pytest.approx(sum(contexts) / len(q))
    assert not q or got.perplexity == pytest.approx(math.exp(-log / len(q)))


def test_rows_divisible_by_every_are_scored_against_all_others(spark):
    r = random.Random(4)
    texts = [" ".join(r.choices("abcd", k=r.randint(1, 40))) for _ in range(14)]
    texts += [texts[3], texts[6] + " " + texts[6], "", None, "only", " ".join(r.choices("abcdefgh", k=150))]
    texts.append(texts[-1])
    rows = [*enumerate(texts), (6, texts[6]), (9, "a b " + texts[2]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, key int").repartition(3)
    got = infinigram.scores(docs, every=3, shard_words=150, block_words=120).collect()
    want = [(i, t) for i, t in rows if i is not None and i % 3 == 0]
    assert sorted(x.doc_id for x in got) == sorted(i for i, _ in want)
    for i, t in want:
        others = [words(u) for j, u in rows if (j, u) != (i, t)]
        one = [x for x in got if x.doc_id == i and x.n_words == len(words(t))]
        same(one[0], words(t), others)


def test_queries_from_elsewhere(spark):
    r = random.Random(8)
    corpus = [" ".join(r.choices("abc", k=20)) for _ in range(9)]
    queries = spark.createDataFrame([(1, corpus[2]), (None, "a b z"), (3, None), (3, None)], "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    for x in infinigram.scores(docs, queries, id_col="item_id").withColumnRenamed("item_id", "doc_id").collect():
        same(x, words({1: corpus[2], None: "a b z", 3: None}[x.doc_id]), [c.split() for c in corpus])
    assert infinigram.scores(docs, queries, id_col="item_id").count() == 4


def test_a_long_text_that_stands_in_the_corpus_and_empty_tables(spark):
    r = random.Random(1)
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30_000))
    docs = spark.createDataFrame([(100, long), (1, long), (200, "a a a a"), (2, "a a")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in infinigram.scores(docs).collect()}
    assert got[100].longest_context == 29_999 and got[100].unseen == 0 and got[200].longest_context == 2
    empty = docs.where("doc_id < 0")
    assert infinigram.scores(empty).count() == 0
    assert [x.perplexity for x in infinigram.scores(empty, docs.where("doc_id = 2")).collect()] == [pytest.approx(1)]


def test_what_is_indexed_follows_the_words_shared_with_queries(spark, monkeypatch):
    r = random.Random(5)
    own, other = (["".join(r.choices("abcdefgh", k=6)) for _ in range(k)] for k in (200, 3_000))
    copied = " ".join(own[50:90])
    texts = [" ".join(own), *(f"{r.choice(other)} x{k} {copied} y{k}" for k in range(30)), *(" ".join(r.sample(other, 100)) for _ in range(300))]
    docs = spark.createDataFrame([(100 if k == 0 else 100 * k + 1, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    sizes, write = {}, infinigram.written

    def written(df, name):
        out = write(df, name)
        if "words" in out.columns:
            sizes[name] = sum(len(x.words) // 8 for x in out.where("words IS NOT NULL").collect())
        return out

    monkeypatch.setattr(infinigram, "written", written)
    got = infinigram.scores(docs).collect()
    same(got[0], own, [t.split() for t in texts[1:31]] + [[w] for t in texts[31:] for w in t.split()])
    # of 31,600 words the query's own row and one run for its 30 copies
    assert 240 <= sizes["runs"] <= 300 and sizes["scanned"] <= 500
