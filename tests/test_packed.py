import random
from collections import Counter

import pyarrow as pa
import pytest

from textloom.operators import packed, stats

TEXTS = [(1, "a b a b\tc"), (1, "a b"), (2, "a  b\n\nc \r\f d"), (None, "a b x"), (None, "a b"), (3, None), (4, ""), (5, " é 한국 é 한국 "), (6, "word"), (7, "\n"), (8, "x" * 300 + " a b")]


def brute(rows):
    n, ids = Counter(), {}
    for i, t in rows:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if x]
        for p in zip(w, w[1:]):
            n[p] += 1
            ids.setdefault(p, set()).update(() if i is None else (i,))
    return {p: (k, len(ids[p])) for p, k in n.items()}


@pytest.mark.parametrize("rows", [TEXTS, [r for r in TEXTS if r != (1, "a b")], TEXTS[:0]])
def test_pairs_are_those_of_brute_force(spark, rows):
    """Ids that repeat count once, null ones not at all."""
    got = stats.token_pairs(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()
    assert {(r.x, r.y): (r.n, r.df) for r in got} == brute(rows) and len(got) == len(brute(rows))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_pairs_are_shuffled_once(spark):
    pairs = stats.token_pairs(spark.createDataFrame(TEXTS[2:], "id bigint, t string"), "id", "t")
    assert exchanges(pairs) == 1
    high = stats.kneser_ney(pairs, grouped=True)[0]
    plan = high._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Join" not in plan.replace("BroadcastNestedLoopJoin", "")


class Local:
    """Enough of a table to run one step in this process."""

    def mapInArrow(self, run, _):
        self.run = run
        return self

    repartition = sortWithinPartitions = select = where = lambda self, *_: self


def test_small_holds_give_the_same(monkeypatch):
    """Parts of many flushes, rows of an x over many batches."""
    monkeypatch.setattr(packed, "HELD", 7)
    monkeypatch.setattr(packed, "TEXT", 20)
    monkeypatch.setattr(packed, "ROWS", 2)
    r = random.Random(5)
    rows = [(i, " ".join(r.choices("a b c d é".split(), [20, 5, 2, 1, 1], k=r.randrange(9)))) for i in range(60)]
    step = lambda make, batches: list(make.run(iter(batches)))
    texts = pa.table({"id": [i for i, _ in rows], "t": [t for _, t in rows]}).to_batches(max_chunksize=8)
    sent = pa.Table.from_batches(step(packed.text_parts(Local()), texts)).sort_by("bucket").to_batches(max_chunksize=3)
    pairs = step(packed.merged(Local(), ["x", "y", "n", "df"]), sent)
    t = pa.Table.from_batches(pairs).to_pylist()
    assert {(p["x"], p["y"]): (p["n"], p["df"]) for p in t} == brute(rows) and len(t) == len(brute(rows))
    back = pa.Table.from_batches(step(packed.turned(Local(), stats._behind), pairs)).sort_by("bucket").to_batches(max_chunksize=3)
    known = pa.Table.from_batches(step(packed.merged(Local(), ["y", "x", "n", "total", "k1", "k2", "k3", "c"], stats._known_before), back)).to_pylist()
    assert {(p["x"], p["y"]) for p in known} == set(brute(rows)) and len(known) == len(t)
    for k in known:
        behind = [p["n"] for p in t if p["x"] == k["x"]]
        assert (k["total"], k["k1"], k["k2"], k["k3"]) == (sum(behind), behind.count(1), behind.count(2), sum(n > 2 for n in behind))
        assert k["c"] == sum(p["y"] == k["y"] for p in t) and (k["n"],) == tuple(p["n"] for p in t if (p["x"], p["y"]) == (k["x"], k["y"]))


def test_model_of_some_pairs(spark):
    """What a text's pairs need of the model is the same as in the whole one."""
    r = random.Random(3)
    pairs = stats.token_pairs(spark.createDataFrame([(i, " ".join(r.choices("a b c d e f g".split(), [9, 5, 3, 2, 1, 1, 1], k=12))) for i in range(9)], "id bigint, t string"), "id", "t")
    texts = spark.createDataFrame([(1, "a b zz a c"), (2, None)], "id bigint, t string")
    scores = [stats.kn_scores(texts, "id", "t", stats.kneser_ney(pairs, True, only)).collect() for only in (None, stats.row_pairs(texts, "id", "t"))]
    assert [s.id for s in scores[0]] == [1] == [s.id for s in scores[1]] and scores[0][0].log_prob == pytest.approx(scores[1][0].log_prob)
