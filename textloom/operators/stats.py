"""Corpus statistics: word candidates by branching entropy and cohesion, repeated substrings, token n-grams, and a Kneser-Ney model, all as DataFrame plans.

Words are runs of anything but white space, characters are code points. Begin and end of a word count as characters of their own ("^" and "$" stand for them in contexts). Counting is done within
each distinct word first: words are counted once (one shuffle of words with map-side sums), and everything about characters is worked out on the table of distinct words, weighted by their counts.

Null and empty texts have no words; empty tables give empty results; ids may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed

WORD = "[^ \\n\\t\\r\\f]+"
#: What lies beyond an entropy's context counts as this many equal parts.
DEFAULT_PERPLEXITY = 4.0


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n."""
    return docs.select(F.explode(tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def char_counts(words: DataFrame, least: int = 1) -> DataFrame:
    """chr, n of word_counts(), each at least `least`."""
    chars = words.select(F.explode(F.split("word", "")).alias("chr"), "n").where("chr != ''")
    return chars.groupBy("chr").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def coverage(counts: DataFrame, share: float) -> DataFrame:
    """The most frequent characters that make up `share` of all characters. The running sum is over the alphabet, not the text."""
    order = Window.orderBy(F.desc("n"), F.asc("chr"))
    running = counts.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return running.where(F.col("before") < F.col("total") * share).select("chr", "n")


def bigrams(words: DataFrame, least: int) -> DataFrame:
    """x, y, n: pairs of characters next to each other in words, "^" and "$" being the ends."""
    marked = words.select(F.concat(F.array(F.lit("^")), F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit("$"))).alias("c"), "n")
    pairs = marked.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda k: F.struct(F.element_at("c", k).alias("x"), F.element_at("c", k + 1).alias("y")))).alias("p"), "n")
    return pairs.select("p.*", "n").groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def pieces(words: DataFrame, longest: int, least: int) -> DataFrame:
    """piece, n: parts of 1 to `longest` characters of words that begin at the word's beginning, at least `least` times."""
    parts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest))), lambda k: F.substring("word", 1, k))).alias("piece"), "n")
    return parts.groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def branching(counts: DataFrame, piece: str, after: str, n: str) -> DataFrame:
    """piece, entropy of what follows it: counts has the count of each piece and following character ("$": the word's end, whose share counts as DEFAULT_PERPLEXITY equal parts)."""
    total = counts.groupBy(piece).agg(F.sum(n).alias("total"))
    p = F.col(n) / F.col("total")
    part = F.when(F.col(after) == "$", p * (F.log(F.lit(DEFAULT_PERPLEXITY)) - F.log(p))).otherwise(-p * F.log(p))
    return counts.join(total, piece).groupBy(F.col(piece)).agg(F.sum(part).alias("entropy"), F.first("total").alias("n"))


def word_candidates(words: DataFrame, least: int = 10, longest: int = 10, least_score: float = 0.1) -> DataFrame:
    """form, n, left_entropy, right_entropy, left_cohesion, right_cohesion, score: parts at the beginning of words that stand by themselves. Entropies are of the characters around a form in the corpus, cohesions say how
    much of what begins (or ends) alike goes on to be the form, as a mean over its characters; score is the product of the four."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    inside = words.select(letters.alias("c"), "n").where(F.size("c") > 0)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("c")), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.size("c") - a + 1, F.lit(longest))), lambda k: F.struct(
        F.array_join(F.slice("c", a, k), "").alias("form"), k.alias("size"),
        F.when(a > 1, F.element_at("c", F.greatest(a - 1, F.lit(1)))).otherwise(F.lit("$")).alias("before"),
        F.when(a + k <= F.size("c"), F.element_at("c", F.least(a + k, F.size("c")))).otherwise(F.lit("$")).alias("after")))))
    forms = inside.select(F.explode(spans).alias("s"), "n").groupBy("s.form", "s.size", "s.before", "s.after").agg(F.sum("n").alias("n"))
    counts = forms.groupBy("form", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    right = branching(forms.groupBy("form", "after").agg(F.sum("n").alias("n")), "form", "after", "n").select("form", F.col("entropy").alias("right_entropy"))
    left = branching(forms.groupBy("form", "before").agg(F.sum("n").alias("n")), "form", "before", "n").select("form", F.col("entropy").alias("left_entropy"))
    alone = counts.where("size = 1").select(F.col("form").alias("chr"), F.col("n").alias("single"))
    long = counts.where("size > 1").join(right, "form").join(left, "form")
    long = long.join(alone.select(F.col("chr").alias("head"), F.col("single").alias("n_head")), F.left("form", F.lit(1)) == F.col("head")).join(alone.select(F.col("chr").alias("tail"), F.col("single").alias("n_tail")), F.right("form", F.lit(1)) == F.col("tail"))
    root = 1 / (F.col("size") - 1)
    scored = long.withColumn("left_cohesion", F.pow(F.col("n") / F.col("n_head"), root)).withColumn("right_cohesion", F.pow(F.col("n") / F.col("n_tail"), root))
    return scored.withColumn("score", F.col("left_cohesion") * F.col("right_cohesion") * F.col("left_entropy") * F.col("right_entropy")).where(F.col("score") >= least_score).select("form", "n", "left_entropy", "right_entropy", "left_cohesion", "right_cohesion", "score")


def substrings(docs: DataFrame, id_col: str, text_col: str, least: int = 2, shortest: int = 2, longest: int = 32, longest_only: bool = True, stop: str = " ") -> DataFrame:
    """id, substring, n: substrings of each text between stop characters, at least `least` times, without those that repeat a beginning; with longest_only without any that one more character on either side leaves as frequent."""
    segments = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.col(text_col), "[" + stop.replace("\\", "\\\\") + "]")).alias("s")).where(F.length("s") >= shortest)
    # equal segments of a text are counted before they are cut up
    segments = segments.groupBy("id", "s").agg(F.count("*").alias("n"))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.length("s") - shortest + 1), lambda a: F.transform(F.sequence(F.lit(shortest), F.least(F.length("s") - a + 1, F.lit(longest))), lambda k: F.substr(F.col("s"), a, k))))
    counted = segments.select("id", "n", F.explode(cut).alias("substring")).groupBy("id", "substring").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    repeats = (F.length("substring") >= 5) & F.rlike("substring", F.lit(r"(?s)^(.+?)\1\1+$"))
    plain = counted.where(~repeats)
    if not longest_only:
        return plain
    parents = plain.where(F.length("substring") > shortest).select("id", "n", F.explode(F.array(F.left("substring", F.length("substring") - 1), F.right("substring", F.length("substring") - 1))).alias("substring")).distinct()
    return plain.join(parents, ["id", "substring", "n"], "left_anti")


def row_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, x, y, n: pairs of words next to each other in the texts of an id."""
    w = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    pairs = F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda y, i: F.struct(F.element_at("w", (i + 1).cast("int")).alias("x"), y.alias("y")))
    return w.select("id", F.explode(pairs).alias("p")).groupBy("id", "p.x", "p.y").agg(F.count("*").alias("n"))


def token_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """x, y, n, df: pairs of words next to each other, how often they occur and with how many different ids (null is none). Pairs are counted within their task first and sent in one packed shuffle, in which the rows of an x follow one another. Ids that
    occur more than once (looked for at once) are counted apart: only their pairs are shuffled with them."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    again = d.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    if again.isEmpty():
        sent = packed.text_parts(d)
    else:
        several = row_pairs(d.join(again, "id", "left_semi"), "id", "text").select("x", "y", "n", F.lit(1).cast("bigint").alias("df"))
        sent = packed.text_parts(d.join(again, "id", "left_anti")).union(packed.row_parts(several, "x", "y", ["n", "df"]))
    return packed.merged(sent, ["x", "y", "n", "df"])


def prefix_counts(docs: DataFrame, text_col: str, longest: int = 3, least: int = 5) -> DataFrame:
    """gram, size, n: sequences of 1 to `longest` words, at least `least` times."""
    w = docs.select(tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.size("w") - a + 1, F.lit(longest))), lambda k: F.struct(F.array_join(F.slice("w", a, k), " ").alias("gram"), k.alias("size")))))
    return w.select(F.explode(grams).alias("g")).groupBy("g.gram", "g.size").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def npmi(pairs: DataFrame, words: DataFrame, least: int = 5) -> DataFrame:
    """x, y, n, df, npmi, left_branch, right_branch, score: pairs of words by pointwise mutual information over -ln p(x, y), by the entropies of what stands beside them, and their product as far as it counts."""
    total = words.agg(F.sum("n").alias("total"))
    known = pairs.where(F.col("n") >= least).join(words.select(F.col("word").alias("x"), F.col("n").alias("nx")), "x").join(words.select(F.col("word").alias("y"), F.col("n").alias("ny")), "y").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    scored = known.withColumn("npmi", pmi / F.log(F.col("total") / F.col("n")))
    right = pairs.groupBy("x").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s")).select("x", (F.log("t") - F.col("s") / F.col("t")).alias("right_branch"))
    left = pairs.groupBy("y").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s")).select("y", (F.log("t") - F.col("s") / F.col("t")).alias("left_branch"))
    out = scored.join(right, "x").join(left, "y")
    return out.select("x", "y", "n", "df", "npmi", "left_branch", "right_branch", (F.col("npmi") * F.least(F.sqrt(F.col("left_branch") * F.col("right_branch")) / F.log(F.col("n") + 1), F.lit(1.0))).alias("score"))


def discounts(counts: DataFrame, every: bool = False) -> DataFrame:
    """d1, d2, d3: discounts of counts 1, 2, and 3 or more, from the counts of counts 1 to 4 (one row; a missing count of counts is 1); with every also all, the number of counts."""
    n = counts.agg(*[F.greatest(F.sum((F.col("n") == k).cast("bigint")), F.lit(1)).cast("double").alias(f"n{k}") for k in range(1, 5)], F.count("*").alias("all"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return n.select(*[F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.0)), F.lit(float(k))).alias(f"d{k}") for k in (1, 2, 3)], *(["all"] if every else []))


def _behind(n: np.ndarray, first: np.ndarray) -> packed.Columns:
    """Of each x, whose rows begin at first: the sum of n, and how many are 1, 2, and more."""
    return [np.add.reduceat(v.astype(np.int64), first) for v in (n, n == 1, n == 2, n > 2)]


def _known_before(fan: np.ndarray, x: np.ndarray, columns: packed.Columns) -> tuple[None, packed.Columns]:
    return None, [*columns, fan[x]]


def _behind_each(pairs: DataFrame) -> DataFrame:
    """x, total, k1, k2, k3: what stands behind each word, and how many different words once, twice, and more often."""
    return pairs.groupBy("x").agg(F.sum("n").alias("total"), *[F.sum(c.cast("bigint")).alias(k) for k, c in (("k1", F.col("n") == 1), ("k2", F.col("n") == 2), ("k3", F.col("n") > 2))])


_GAMMA = "(k1 * d1 + k2 * d2 + k3 * d3) / total"
_HIGH = f"ln(greatest(n - CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END, 0D) / total + {_GAMMA} * (c / `all`))"


#: Bytes of strings and rows up to which what a text has is broadcast to the corpus; more is shuffled.
_BROADCAST = 64 << 20


def _sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small; it is counted for that."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in df.columns), F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if size <= _BROADCAST else df


def kneser_ney(pairs: DataFrame, grouped: bool = False, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A word bigram model with modified Kneser-Ney discounts from token_pairs(): (x, y, log_p), (x, log_gamma: weight of the lower order behind x), (y, log_p: lower order, by the different words before y). With grouped the rows of an x follow one another in
    their task, as token_pairs() has them; otherwise they are brought together first. Pairs go to their y with what is known of their x, in one packed shuffle; nothing is joined. With only (x, y) the model has just what these pairs and their words need."""
    d = F.broadcast(discounts(pairs, every=True))
    if only is None:
        by_x = pairs if grouped else packed.merged(packed.row_parts(pairs, "x", "y", ["n"]), ["x", "y", "n"])
        both = packed.merged(packed.turned(by_x, _behind), ["y", "x", "n", "total", "k1", "k2", "k3", "c"], _known_before)
        of_x, of_y = pairs, pairs
    else:
        asked = [_sized(only.select(*c).distinct()) for c in (["x"], ["y"], ["x", "y"])]
        of_x, of_y, of_both = (pairs.join(a, a.columns, "left_semi") for a in asked)
    behind, before = _behind_each(of_x), of_y.groupBy("y").agg(F.count("*").alias("c"))
    if only is not None:
        both = of_both.join(behind, "x").join(before, "y")
    context = behind.crossJoin(d).select("x", F.log(F.expr(_GAMMA)).alias("log_gamma"))
    lower = before.crossJoin(d).select("y", F.log(F.col("c") / F.col("all")).alias("log_p"))
    return both.crossJoin(d).select("x", "y", F.expr(_HIGH).alias("log_p")), context, lower


def kn_scores(docs: DataFrame, id_col: str, text_col: str, model: tuple[DataFrame, DataFrame, DataFrame], floor: float = -100.0) -> DataFrame:
    """id, n_pairs, log_prob: the sum of log P(word | word before) over each text's word pairs; unseen pairs back off, unseen words have the floor. Pairs are counted within their row first."""
    high, context, lower = model
    known = row_pairs(docs, id_col, text_col).join(high, ["x", "y"], "left").join(context, "x", "left").join(lower.withColumnRenamed("log_p", "low"), "y", "left")
    score = F.coalesce("log_p", F.col("low") + F.coalesce("log_gamma", F.lit(0.0)), F.lit(floor))
    return known.groupBy("id").agg(F.sum("n").alias("n_pairs"), F.sum(score * F.col("n")).alias("log_prob"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with number, from 0 in the given order. Meant for vocabularies: the order is total, so one task numbers the rows."""
    return df.withColumn("number", F.row_number().over(Window.orderBy(*order)) - 1)


def contexts(pairs: DataFrame) -> DataFrame:
    """x, n, kinds, entropy of token_pairs(): how often each word has one behind it, how many different ones, and how evenly."""
    return pairs.groupBy("x").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def pruned(candidates: DataFrame, share: float = 0.9, longest: int = 10) -> DataFrame:
    """Candidates (form, n, ...) without those that nearly always stand within a longer candidate: `share` of their places are its beginning or end."""
    longer = candidates.select(F.col("form").alias("long"), F.col("n").alias("n_long"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("form") - 1, F.lit(longest))), lambda k: F.array(F.left("form", k), F.right("form", k)))))).alias("form"))
    most = longer.groupBy("form").agg(F.max("n_long").alias("n_long"))
    return candidates.join(most, "form", "left").where(F.coalesce(F.col("n_long") < F.col("n") * share, F.lit(True))).drop("n_long")


def skip_pairs(docs: DataFrame, text_col: str, window: int = 8, least: int = 5) -> DataFrame:
    """x, y, n, pmi: words with y up to `window` words behind x, at least `least` times, and their pointwise mutual information. Pairs are counted within their row first."""
    w = docs.select(tokens(F.col(text_col)).alias("w")).where(F.size("w") > 1)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda a: F.transform(F.slice("w", a + 1, F.least(F.lit(window), F.size("w") - a)), lambda y: F.struct(F.element_at("w", a).alias("x"), y.alias("y")))))
    counted = w.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n"))
    left, right = counted.groupBy("x").agg(F.sum("n").alias("nx")), counted.groupBy("y").agg(F.sum("n").alias("ny"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.where(F.col("n") >= least).join(left, "x").join(right, "y").crossJoin(F.broadcast(total)).select("x", "y", "n", F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny"))).alias("pmi"))


def context_ids(docs: DataFrame, id_col: str, text_col: str, known: DataFrame, longest: int = 3) -> DataFrame:
    """id, place, context_id: for each word (place from 0) the longest run of words up to and with it that known(gram, context_id) has; null without any."""
    w = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    ends = w.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.struct((k - 1).alias("place"), F.transform(F.sequence(F.lit(1), F.least(k, F.lit(longest))), lambda m: F.array_join(F.slice("w", k - m + 1, m), " ")).alias("grams")))).alias("e"))
    each = ends.select("id", "e.place", F.posexplode("e.grams").alias("m", "gram")).join(known.select("gram", "context_id"), "gram", "left")
    return each.groupBy("id", "place").agg(F.max_by("context_id", F.when(F.col("context_id").isNotNull(), F.col("m"))).alias("context_id"))


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = 4) -> DataFrame:
    """id, target, context: each word of a text with up to `size` words before it."""
    w = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w")).where(F.size("w") > 1)
    each = F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.struct(F.element_at("w", k).alias("target"), F.slice("w", F.greatest(k - size, F.lit(1)), F.least(k - 1, F.lit(size))).alias("context")))
    return w.select("id", F.explode(each).alias("x")).select("id", "x.*")


def weighted_sample(df: DataFrame, key: list[str], weight_col: str, n: int, seed: int = 7) -> DataFrame:
    """n rows without replacement in proportion to their weights: those of the largest -ln(u) / w turned round, with u from a seeded hash of the key. Rows without a positive weight are never drawn."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12).cast("double") + 0.5) / float(2**52)
    return df.where(F.col(weight_col) > 0).withColumn("draw", -F.log(u) / F.col(weight_col)).orderBy("draw", *key).limit(n).drop("draw")


def chr_ids(text: Column, vocabulary: str) -> Column:
    """array<int>: the number of each character in the vocabulary, from 1; 0 for others."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(vocabulary)))


#: Ends of lines: CR and LF together are one.
LINE_END = "\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"


def words_and_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, word_position, line_number, begin, form: each run of non-space characters with its place among them and the line it begins in. One pass over each text in Arrow batches; words go back at every packed.ROWS rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, end = re.compile(r"[^\s]+"), re.compile(LINE_END)

        def batch(ids: pa.Array, rows: list[int], place: list[int], line: list[int], begin: list[int], form: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int32()) for x in (place, line, begin)), pa.array(form, pa.string())], names=["id", "word_position", "line_number", "begin", "form"])

        for b in batches:
            rows, place, line, begin, form = [], [], [], [], []
            for i, v in enumerate(b.column(1)):
                text = v.as_py() or ""
                ends = [m.end() for m in end.finditer(text)]
                k = 0
                for n, m in enumerate(word.finditer(text)):
                    while k < len(ends) and ends[k] <= m.start():
                        k += 1
                    rows.append(i)
                    place.append(n)
                    line.append(k)
                    begin.append(m.start())
                    form.append(m.group())
                    if len(rows) >= packed.ROWS:
                        yield batch(b.column(0), rows, place, line, begin, form)
                        rows, place, line, begin, form = [], [], [], [], []
            yield batch(b.column(0), rows, place, line, begin, form)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, word_position int, line_number int, begin int, form string")
