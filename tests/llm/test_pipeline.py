"""run() against brute force, stage by stage: each stage's rows from its own input in plain Python."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from textloom.llm import decontaminate, lines, mixing, near, quality
from textloom.llm.common import words

from .test_operators import most_that_fits


def sentence(r: random.Random, n: int = 12) -> str:
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n)).capitalize() + "."


def text(r: random.Random, n: int = 8) -> str:
    return "\n".join(sentence(r) for _ in range(n))


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    r = random.Random(17)
    folder = tmp_path_factory.mktemp("sf")
    items = [" ".join(sentence(r, 30).lower().strip(".").split()) for _ in range(3)]
    shared = "\n".join(sentence(r, 15) for _ in range(5))
    rows = []
    for i in range(240):
        t = text(r)
        if i % 6 == 0:
            t = " ".join("".join(r.choices("0123456789#$%", k=6)) for _ in range(60))  # junk
        elif i % 10 == 1:
            t += "\n" + shared
        elif i % 10 == 2 and i > 20:
            w = rows[i - 11][1].split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 30 == 3:
            t = t + "\n" + items[i % 3] + "\n" + text(r, 25)
        elif i % 30 == 4:
            t = items[i % 3]
        rows.append((i, t, ["en", "de"][i % 2], f"s{i % 4}", len(t)))
    rows += [rows[25], (400, None, "en", "s1", 0), (401, "", None, None, 0), (None, text(r), "en", None, 5)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.Table.from_pylist([dict(zip(names, x)) for x in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), folder / "documents.parquet")
    labels = [(i, 0 if i % 6 == 0 else 1, 0) for i in range(0, 240)] * 8
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": items}), folder / "benchmark.parquet")
    return str(folder)


def by_quality(rows, labels):
    """Cutoffs by the definition, and the rows that pass."""
    def levels(t):
        chars, parts = max(len(t), 1), t.split("\n")
        score = {"symbols": (chars - sum(c in "#$%&*|<>{}^~=@_\\" for c in t)) / chars, "digits": (chars - sum(c.isascii() and c.isdigit() for c in t)) / chars, "lines": len(set(parts)) / len(parts), "word_length": min(1.0, (t.count(" ") + len(parts)) * 9 / chars)}
        return {k: int(v * quality.GRID // 1) for k, v in score.items()}

    known = [(levels(t or ""), g or "", y) for i, t, g, *_ in rows for j, y in labels if i == j and (t or "").strip()]
    strata = {g for _, g, _ in known}
    limit = quality.DELTA / (4 * max(1, len(strata)))
    cuts = {}
    for g in strata:
        for rule in quality.rules_names():
            good, bad = ([x[rule] for x, h, y in known if h == g and y == k] for k in (1, 0))
            gains = {}
            for k in range(1, quality.GRID + 1):
                lost = sum(x < k for x in good)
                if not good or not bad or quality._log_binomial_cdf(lost, len(good), quality.ALPHA / 4) > __import__("math").log(limit):
                    break
                gains[k] = sum(x < k for x in bad) / len(bad) - lost / len(good)
            if gains and max(gains.values()) >= quality.LEAST_GAIN:
                cuts[g, rule] = min(k for k, v in gains.items() if v >= max(gains.values()) - quality.SLACK)
    return [r for r in rows if (r[1] or "").strip() and all(levels(r[1])[rule] >= cuts.get((r[2] or "", rule), 0) for rule in quality.rules_names())]


def test_every_stage_is_what_brute_force_makes_of_its_input(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    before = sorted(map(tuple, docs.collect()), key=key)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = sorted(map(tuple, docs.collect()), key=key)
        seen[name] = (before, after)
        before = after

    rows, kept = seen["quality_rules"]
    labels = [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    assert kept == by_quality(rows, labels) and len(kept) < len(rows)

    rows, kept = seen["line_dedup"]
    after = {r[0]: r for r in kept}
    earlier: list[list[tuple]] = []
    for r in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        own = [tuple(words(x)) for x in lines.cut(r[1]) if words(x)]
        gone = set()
        for x in earlier:
            for a in range(len(x)):
                for b in range(len(own)):
                    n = 0
                    while a + n < len(x) and b + n < len(own) and x[a + n] == own[b + n]:
                        n += 1
                    if sum(map(len, own[b : b + n])) >= lines.WINDOW_WORDS:
                        gone.update(range(b, b + n))
        earlier.append(own)
        left = [own[k] for k in range(len(own)) if k not in gone]
        got = [tuple(words(x)) for x in lines.cut(after[r[0]][1]) if words(x)] if r[0] in after else []
        # every run of over 50 words is gone; a shorter one may be
        assert len(got) <= len(left) and all(x in own for x in got), r[0]
        if not gone and r[0] in after and len(got) == len(own):
            assert after[r[0]][1] == r[1]

    rows, kept = seen["near_duplicates"]
    docs_, grams = sorted({r[:2] for r in rows}, key=key), {}
    for d in docs_:
        w = words(d[1])
        grams[d] = frozenset(tuple(w[k : k + near.N]) for k in range(max(1, len(w) - near.N + 1))) if w else frozenset()
    root = {d: d for d in docs_}
    for i, d in enumerate(docs_):
        for e in docs_[i + 1 :]:
            if grams[d] and grams[e] and (grams[d] == grams[e] or len(grams[d] & grams[e]) / len(grams[d] | grams[e]) >= near.THRESHOLD):
                a, b = root[d], root[e]
                root = {x: min(a, b, key=key) if r in (a, b) else r for x, r in root.items()}
    assert sorted((r[:2] for r in kept), key=key) == sorted((d for d in docs_ if root[d] == d), key=key)

    rows, kept = seen["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    known = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    want = []
    for r in rows:
        w = words(r[1])
        hit = {k + j for k in range(len(w) - 7) if tuple(w[k : k + 8]) in known for j in range(8)}
        if not hit or len(hit) < decontaminate.DROP_SHARE * len(w):
            want.append((r[0], [x for k, x in enumerate(w) if k not in hit]))
    assert [(r[0], words(r[1])) for r in kept] == want and any(len(x) != len(words(r[1])) for r, (_, x) in zip(rows, want)) | (len(want) < len(rows))

    rows, kept = seen["source_mixing"]
    by = {}
    for r in rows:
        by.setdefault(r[3] or "", []).append(len((r[1] or "").split()))
    tokens = {s: sum(x) for s, x in by.items()}
    weights = {s: t**mixing.TEMPERATURE for s, t in tokens.items()}
    whole = sum(weights[s] for s in sorted(weights))
    most = min(int(tokens[s] * whole / w) for s, w in weights.items())
    for s, w in weights.items():
        taken = [len(r[1].split()) for r in kept if (r[3] or "") == s]
        assert sum(taken) == most_that_fits({n: by[s].count(n) for n in set(by[s])}, min(tokens[s], int(most * w / whole)))
    assert set(kept) <= set(rows)


def test_run_is_all_stages_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "source_mixing"]


def test_run_takes_an_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
