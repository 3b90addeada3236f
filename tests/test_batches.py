"""What is found in a batch of texts goes back bit by bit: a task's memory doesn't follow the size of a batch."""

import random

import pyarrow as pa
import pytest

from textloom.functions import patterns
from textloom.operators import analyzer, packed, stats


class Local:
    """Enough of a table to run one step in this process."""

    class Field:
        class dataType:  # noqa: N801
            simpleString = staticmethod(lambda: "bigint")

    class sparkSession:  # noqa: N801
        class sparkContext:  # noqa: N801
            broadcast = staticmethod(lambda x: type("Shared", (), {"value": x}))

    schema = {"id": Field}

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


TEXT = "a.b 1 2:3 x@y.org word. "
MAKERS = {
    "pattern_spans": lambda df: patterns.pattern_spans(df, "id", "text"),
    "words_and_lines": lambda df: stats.words_and_lines(df, "id", "text"),
    "analyze": lambda df: analyzer.analyze(df, "id", "text"),
}


@pytest.mark.parametrize("name", MAKERS)
def test_batches_are_bounded(spark, monkeypatch, name):
    texts = [TEXT * 3, None, "", TEXT * 10, *[TEXT] * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    whole = pa.Table.from_batches(list(MAKERS[name](Local()).run(iter([batch])))).to_pylist()
    for module, limit in ((patterns, "ROWS"), (packed, "ROWS"), (analyzer, "TOKENS_HELD")):
        monkeypatch.setattr(module, limit, 20)
    got = list(MAKERS[name](Local()).run(iter([batch])))
    assert pa.Table.from_batches(got).to_pylist() == whole and len(whole) >= len(texts)
    most = max(sum(len(t) for t in b["tokens"].to_pylist()) if name == "analyze" else b.num_rows for b in got)
    assert len(got) > 5 and most < 200


def test_spans_are_those_of_a_scan_of_every_character():
    p, r = patterns.compiled(), random.Random(1)
    letters = [*"aBcdeXyZ129０５.,:-/@#*%+_~ \n\t\"(", "http://", "https://", "www.", "a.b", "é", "한", "😀", "👍🏽", "🇰🇷", "🇰", "️", "⃣", "‍", "👩", "…", "①"]
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randrange(1, 25)))
        assert [(a, b) for a, b, _ in patterns.spans(text, p)] == [m.span() for m in p.finditer(text)]
    assert len(patterns.starts("word " * 1000 + "end.")) == 3
