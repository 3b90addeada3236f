"""Registered queries of the text engine and their DuckDB SQL. Every query runs over its whole table; where no table holds such text (Hangul, brackets), over literal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, hangul, patterns
from ..operators import analyzer, combiner, evaluation, intervals, similarity, stats, subword, typos
from ..sources import lexicon
from ..streaming import analysis as streams

#: Single kinds of addresses in expressions that RE2 has too.
URL = r"https?://[-a-zA-Z0-9@:%._+~#=][-a-zA-Z0-9@:%._+~#=]*\.[A-Za-z]{2,}(?::[0-9]+)?(?:/[-a-zA-Z0-9()@:%_+.~#!?&/=]*)?"
EMAIL = r"[-A-Za-z0-9._%+]+@[-A-Za-z0-9.]+\.[A-Za-z]{2,}"
HASHTAG = r"#[^# \t\n\r\v\f.,()\[\]<>{}]+"
WORD = stats.WORD
NOUNS = ("시동", "시도", "바닥", "한국", "나무", "됬다", "불", "좋", "하늘", "abc")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and texts of all documents; where the file has fewer splits than there are cores, its rows are spread first."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(values: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) + ")" for r in values) + f") AS v({names})"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_U = "unicode(c)"
_A = "ascii(c)"

# --- patterns and white space


@query(f"SELECT page_id, len(regexp_extract_all(url, {_quoted(URL)})) AS urls, len(regexp_extract_all(html, {_quoted(EMAIL)})) AS emails, len(regexp_extract_all(html, {_quoted(HASHTAG)})) AS hashtags FROM pages")
def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    count = lambda c, x: F.regexp_count(c, F.lit(x.replace(r"\v", r"\x0B"))).cast("bigint")
    return p.select("page_id", count("url", URL).alias("urls"), count("html", EMAIL).alias("emails"), count("html", HASHTAG).alias("hashtags"))


@query()
def pattern_spans_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_spans(_docs(spark, sf_dir), "doc_id", "text")


@query()
def pattern_spans_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_spans(_table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"SELECT page_id AS id, CAST(0 AS INT) AS \"begin\", CAST(len(regexp_extract(url, {_quoted(URL)})) AS INT) AS \"end\", 'W_URL' AS tag, regexp_extract(url, {_quoted(URL)}) AS form FROM pages")
def pattern_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in pages.url, which hold nothing else."""
    return patterns.pattern_spans(_table(spark, sf_dir, "pages"), "page_id", "url").where("tag = 'W_URL'")


PATTERN_CASES = [("12:34에", 0, 5, "W_SERIAL"), ("12.34.0.1", 0, 9, "W_SERIAL"), ("2001. 01. 02. 에", 0, 13, "W_SERIAL"), ("123.4567", 0, 8, "SN"), ("123,456.", 0, 7, "SN"), ("1,234,567원", 0, 9, "SN"), ("@user_name 님", 0, 10, "W_MENTION"), ("#한국어 처리", 0, 4, "W_HASHTAG"), ("메일 a.b@c.org로", 3, 12, "W_EMAIL"), ("😀", 0, 1, "W_EMOJI"), ("U.S.A.", 0, 6, "SL")]


@query(f"SELECT * FROM {_values([(t, a, b, tag, t[a:b]) for t, a, b, tag in PATTERN_CASES], 'id, \"begin\", \"end\", tag, form')}")
def pattern_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_spans(_rows(spark, [(t,) for t, *_ in PATTERN_CASES], "t string"), "t", "t")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM documents")
def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", hangul.collapse_space(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(text, ' ', '') AS text, lower(left(text, 200)) AS lower FROM documents")
def space_and_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.expr(chars.without_space("text")).alias("text"), F.lower(F.left("text", F.lit(200))).alias("lower"))


# --- characters


_CHARS = "SELECT c AS chr, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[ \\t\\r\\n\\f]+', '', 'g'), '')) AS c FROM documents) WHERE c != '' GROUP BY c"


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.char_counts(stats.word_counts(_docs(spark, sf_dir)))


@query(f"SELECT * FROM ({_CHARS}) WHERE n >= 10")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chars(spark, sf_dir).where("n >= 10")


@query(f"SELECT chr, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, chr ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM ({_CHARS})) WHERE before < total * 0.99::DOUBLE")
def char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent characters that make up 99 % of the text."""
    return stats.coverage(_chars(spark, sf_dir), 0.99)


@query(f"SELECT tag, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM (SELECT {chars.char_tag('unicode(chr)')} AS tag, n FROM ({_CHARS})) GROUP BY tag")
def char_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chars(spark, sf_dir).select(F.expr(chars.char_tag("ascii(chr)")).alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


@query(f"SELECT script, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {chars.script('unicode(chr)')} AS script, n FROM ({_CHARS})) GROUP BY script")
def char_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chars(spark, sf_dir).select(F.expr(chars.script("ascii(chr)")).alias("script"), "n").groupBy("script").agg(F.sum("n").alias("n"))


SYMBOLS = "가ㄱᆫA1.?!,(《』’\"~…漢かカдα①😀ｱ−€→ "


@query(f"SELECT c, {chars.char_tag(_U)} AS tag, {chars.script(_U)} AS script, {chars.pair_kind(_U)} AS pair, {chars.vowel_of(_U)} AS vowel, {chars.coda_of(_U)} AS coda FROM {_values([(c,) for c in SYMBOLS], 'c')}")
def char_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rows(spark, [(c,) for c in SYMBOLS], "c string")
    return c.select("c", *[F.expr(x).alias(n) for n, x in (("tag", chars.char_tag(_A)), ("script", chars.script(_A)), ("pair", chars.pair_kind(_A)), ("vowel", chars.vowel_of(_A)), ("coda", chars.coda_of(_A)))])


BULLETS = ("가.", "(나)", "1)", "ㄱ.", "Ⅳ.", "ⅳ)", "①", "❷", "⑴", "⒈", "(3)", "-")


@query(f"SELECT c, {chars.bullet_kind('c', 'unicode(c)', 'unicode(substr(c, 2, 1))')} AS kind FROM {_values([(c,) for c in BULLETS], 'c')}")
def bullet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(c,) for c in BULLETS], "c string").select("c", F.expr(chars.bullet_kind("c", "ascii(c)", "ascii(substr(c, 2, 1))")).alias("kind"))


# --- Hangul


def _nouns(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(n,) for n in NOUNS], "noun string")


_NOUNS = _values([(n,) for n in NOUNS], "noun")
_CODA = "(unicode(right(noun, 1)) BETWEEN 44032 AND 55203 AND (unicode(right(noun, 1)) - 44032) % 28 > 0)"


@query(f"""SELECT noun, array_to_string(list_transform(string_split(replace(noun, '됬', '됐'), ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 AND (unicode(c) - 44032) % 28 > 0
    THEN chr(unicode(c) - (unicode(c) - 44032) % 28) || chr(4519 + (unicode(c) - 44032) % 28) ELSE c END), '') AS normal FROM {_NOUNS}""")
def hangul_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nouns(spark).select("noun", hangul.normalize_hangul(F.col("noun")).alias("normal"))


JAMO = ("한ㄱ", "한국", "가나다", "ᄀaᅡ", "한ᆫ", "", "한ᆫ")


@query(f"SELECT t, nfc_normalize(t) AS joined FROM {_values([(t,) for t in JAMO], 't')}")
def hangul_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t,) for t in JAMO], "t string").select("t", chars.join_hangul(F.col("t")).alias("joined"))


CODA_CASES = [("키윜ㅋㅋ", "키위ㅋㅋㅋ"), ("키윟ㅎ", "키위ㅎㅎ"), ("키윅ㄱ", "키위ㄱㄱ"), ("키윈ㄴㄴ", "키위ㄴㄴㄴ"), ("키윊ㅎㅎ", "키윈ㅎㅎㅎ"), ("키윍ㄱㄱ", "키윌ㄱㄱㄱ"), ("키윅ㅋ", "키윅ㅋ"), ("", "")]


@query(f"SELECT * FROM {_values(CODA_CASES, 't, normal')}")
def coda_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t,) for t, _ in CODA_CASES], "t string").select("t", chars.normalize_coda(F.col("t")).alias("normal"))


@query(f"SELECT t, {chars.standing('t')} AS letters FROM {_values([(t,) for t in JAMO], 't')}")
def standing_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t,) for t in JAMO], "t string").select("t", F.expr(chars.standing("t")).alias("letters"))


@query(f"SELECT noun, noun || CASE WHEN {_CODA} THEN '을' ELSE '를' END AS object, noun || CASE WHEN {_CODA} THEN '이' ELSE '가' END AS subject, noun || CASE WHEN {_CODA} AND (unicode(right(noun, 1)) - 44032) % 28 <> 8 THEN '으로' ELSE '로' END AS toward FROM {_NOUNS}")
def particle_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("noun")
    return _nouns(spark).select("noun", hangul.particle(n, "을", "를").alias("object"), hangul.particle(n, "이", "가").alias("subject"), hangul.particle(n, "으로", "로", vocalic=True).alias("toward"))


@query("SELECT noun, " + ", ".join(f"{chars.meets(c, chars.coda_of('unicode(right(noun, 1))'))} AS \"{c}\"" for c in chars.CONDITIONS) + f" FROM {_NOUNS}")
def ending_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nouns(spark).select("noun", *[F.expr(chars.meets(c, chars.coda_of("ascii(right(noun, 1))"))).alias(c) for c in chars.CONDITIONS])


TAG_NAMES = [(n,) for n in (*chars.MORPH_TAGS, "VV-I", "XSA-R", "NNG-I", "?")]


@query(f"SELECT name, {chars.parsed_tag('name').replace('{group}', chr(92))} AS tag, {chars.tag_name(chars.parsed_tag('name').replace('{group}', chr(92)), 'NOT ends_with(name, ' + chr(39) + '-I' + chr(39) + ')')} AS again FROM {_values(TAG_NAMES, 'name')}")
def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = chars.parsed_tag("name").replace("{group}", "$")
    return _rows(spark, TAG_NAMES, "name string").select("name", F.expr(parsed).alias("tag"), F.expr(chars.tag_name(parsed, "NOT endswith(name, '-I')")).alias("again"))


DIALECT_CASES = [("jeju", 0), ("standard", 1), ("jeju,gyeongsang", 32), ("", 64)]


@query(f"SELECT names, word, {chars.dialect_mask('names', 'list_contains(string_split({0}, {2}), {1})'.replace('{2}', chr(39) + ',' + chr(39)))} AS mask, {chars.dialect_allowed('word', '(' + chars.dialect_mask('names', 'list_contains(string_split({0}, {2}), {1})'.replace('{2}', chr(39) + ',' + chr(39))) + ')')} AS allowed FROM {_values(DIALECT_CASES, 'names, word')}")
def dialect_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = chars.dialect_mask("names", "array_contains(split({0}, ','), {1})")
    return _rows(spark, DIALECT_CASES, "names string, word int").select("names", "word", F.expr(mask).alias("mask"), F.expr(chars.dialect_allowed("word", f"({mask})")).alias("allowed"))


# --- positions


@query(f"SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, '{WORD}')) AS n_words FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("n_lines"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ \\t\\r\\n\\f\\v]+|[^ \\t\\r\\n\\f\\v]+')) AS x, generate_subscripts(regexp_extract_all(text, '[ \\t\\r\\n\\f\\v]+|[^ \\t\\r\\n\\f\\v]+'), 1) AS k FROM documents),
    q AS (SELECT *, NOT regexp_matches(x, '^[ \\t\\r\\n\\f\\v]') AS is_word, coalesce(sum(length(x)) OVER w, 0) AS place, coalesce(sum(CASE WHEN regexp_matches(x, '^[ \\t\\r\\n\\f\\v]') THEN len(regexp_extract_all(x, '\\r\\n|[\\n\\r\\v\\f]')) ELSE 0 END) OVER w, 0) AS line
    FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS word_position, CAST(line AS INT) AS line_number, CAST(place AS INT) AS "begin", x AS form FROM q WHERE is_word""")
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.words_and_lines(_docs(spark, sf_dir), "doc_id", "text")


# --- counts


_PAIRS = f"SELECT doc_id, w[k] AS x, w[k + 1] AS y FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents))"
_XY = f"(SELECT x, y, count(*) AS n, count(DISTINCT doc_id) AS df FROM ({_PAIRS}) GROUP BY x, y)"
_WORDS = f"(SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents) GROUP BY word)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_pairs(_docs(spark, sf_dir), "doc_id", "text")


@query(f"SELECT * FROM {_XY} WHERE n >= 5")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("n >= 5")


@query(f"SELECT y AS word, count(*) AS contexts FROM {_XY} GROUP BY y HAVING count(*) >= 2")
def continuation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney continuation counts: the different words before each word."""
    return _pairs(spark, sf_dir).groupBy(F.col("y").alias("word")).agg(F.count("*").alias("contexts")).where("contexts >= 2")


@query(f"SELECT x, y, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c[k] AS x, c[k + 1] AS y, n FROM (SELECT c, n, unnest(range(1, len(c))) AS k FROM (SELECT list_concat(['^'], string_split(word, ''), ['$']) AS c, n FROM {_WORDS}))) GROUP BY x, y HAVING sum(n) >= 50")
def char_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bigrams(stats.word_counts(_docs(spark, sf_dir)), 50)


@query(f"SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT left(word, k) AS piece, n FROM (SELECT word, n, unnest(range(1, least(length(word), 8) + 1)) AS k FROM {_WORDS})) GROUP BY piece HAVING sum(n) >= 20")
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pieces(stats.word_counts(_docs(spark, sf_dir)), 8, 20)


@query(f"""WITH c AS (SELECT string_split(word, '') AS c, n FROM {_WORDS}), a AS (SELECT c, n, unnest(range(1, len(c) + 1)) AS a FROM c), s AS (SELECT c, n, a, unnest(range(1, least(len(c) - a + 1, 6) + 1)) AS k FROM a),
    f AS (SELECT array_to_string(c[a:a + k - 1], '') AS form, k, CASE WHEN a > 1 THEN c[a - 1] ELSE '$' END AS b, CASE WHEN a + k <= len(c) THEN c[a + k] ELSE '$' END AS e, n FROM s),
    t AS (SELECT form, k, sum(n) AS n FROM f GROUP BY form, k HAVING sum(n) >= 20),
    r AS (SELECT form, sum(CASE WHEN e = '$' THEN p * (ln(4) - ln(p)) ELSE -p * ln(p) END) AS h FROM (SELECT form, e, sum(n) / CAST(sum(sum(n)) OVER (PARTITION BY form) AS DOUBLE) AS p FROM f GROUP BY form, e) GROUP BY form),
    l AS (SELECT form, sum(CASE WHEN b = '$' THEN p * (ln(4) - ln(p)) ELSE -p * ln(p) END) AS h FROM (SELECT form, b, sum(n) / CAST(sum(sum(n)) OVER (PARTITION BY form) AS DOUBLE) AS p FROM f GROUP BY form, b) GROUP BY form),
    o AS (SELECT form, n FROM t WHERE k = 1),
    z AS (SELECT t.form, t.n, l.h AS lh, r.h AS rh, pow(t.n / CAST(x.n AS DOUBLE), 1.0 / (t.k - 1)) AS lc, pow(t.n / CAST(y.n AS DOUBLE), 1.0 / (t.k - 1)) AS rc FROM t JOIN r USING (form) JOIN l USING (form) JOIN o x ON x.form = left(t.form, 1) JOIN o y ON y.form = right(t.form, 1) WHERE t.k > 1)
    SELECT form, CAST(n AS BIGINT) AS n, round(lh, 5) AS left_entropy, round(rh, 5) AS right_entropy, round(lc, 5) AS left_cohesion, round(rc, 5) AS right_cohesion FROM z""")
def word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.word_candidates(stats.word_counts(_docs(spark, sf_dir)), least=20, longest=6, least_score=-1.0)
    return found.select("form", "n", *[F.round(c, 5).alias(c) for c in ("left_entropy", "right_entropy", "left_cohesion", "right_cohesion")])


@query("""WITH s AS (SELECT item_id, s FROM (SELECT item_id, unnest(string_split(text, ' ')) AS s FROM benchmark) WHERE length(s) >= 2), a AS (SELECT item_id, s, unnest(range(1, length(s))) AS a FROM s), k AS (SELECT item_id, s, a, unnest(range(2, least(length(s) - a + 1, 32) + 1)) AS k FROM a),
    c AS (SELECT item_id, substr(s, a, k) AS t, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 2),
    p AS (SELECT * FROM c WHERE length(t) < 5 OR NOT coalesce(list_bool_or(list_transform(range(1, length(t) // 3 + 1), lambda p: length(t) % p = 0 AND repeat(left(t, p), CAST(length(t) // p AS BIGINT)) = t)), false))
    SELECT item_id AS id, t AS substring, n FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.item_id = x.item_id AND y.n = x.n AND length(y.t) = length(x.t) + 1 AND (left(y.t, length(x.t)) = x.t OR right(y.t, length(x.t)) = x.t))""")
def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.substrings(_table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""SELECT gram, size, count(*) AS n FROM (SELECT array_to_string(w[a:a + k - 1], ' ') AS gram, CAST(k AS INT) AS size FROM (SELECT w, a, unnest(range(1, least(len(w) - a + 1, 3) + 1)) AS k FROM (SELECT w, unnest(range(1, len(w) + 1)) AS a FROM (SELECT regexp_extract_all(text, '{WORD}') AS w FROM conversations)))) GROUP BY gram, size HAVING count(*) >= 5""")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.prefix_counts(_table(spark, sf_dir, "conversations"), "text")


@query(f"""WITH p AS MATERIALIZED {_XY}, w AS MATERIALIZED {_WORDS}, t AS (SELECT sum(n) AS t FROM w), r AS (SELECT x, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM p GROUP BY x), l AS (SELECT y, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM p GROUP BY y)
    SELECT p.x, p.y, p.n, p.df, round(ln(p.n * t.t / CAST(wx.n * wy.n AS DOUBLE)) / ln(t.t / CAST(p.n AS DOUBLE)), 5) AS npmi, round(l.h, 5) + 0.0 AS left_branch, round(r.h, 5) + 0.0 AS right_branch FROM p, t, w wx, w wy, r, l WHERE p.n >= 5 AND wx.word = p.x AND wy.word = p.y AND r.x = p.x AND l.y = p.y""")
def token_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    found = stats.npmi(stats.token_pairs(d, "doc_id", "text"), stats.word_counts(d))
    return found.select("x", "y", "n", "df", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("npmi", "left_branch", "right_branch")])


_CUT = "CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END"
_KN = f"""p AS MATERIALIZED {_XY}, q AS (SELECT greatest(count(*) FILTER (n = 1), 1)::DOUBLE AS n1, greatest(count(*) FILTER (n = 2), 1)::DOUBLE AS n2, greatest(count(*) FILTER (n = 3), 1)::DOUBLE AS n3, greatest(count(*) FILTER (n = 4), 1)::DOUBLE AS n4 FROM p),
    d AS MATERIALIZED (SELECT least(greatest(1 - 2 * y * n2 / n1, 0), 1) AS d1, least(greatest(2 - 3 * y * n3 / n2, 0), 2) AS d2, least(greatest(3 - 4 * y * n4 / n3, 0), 3) AS d3 FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM q)),
    c AS MATERIALIZED (SELECT x, sum(n) AS total, sum({_CUT}) / sum(n) AS gamma FROM p, d GROUP BY x), lo AS MATERIALIZED (SELECT y, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pr FROM p GROUP BY y)"""


@query(f"WITH {_KN} SELECT p.x, p.y, round(ln(greatest(n - ({_CUT}), 0) / total + gamma * pr), 5) AS log_p FROM p, d, c, lo WHERE c.x = p.x AND lo.y = p.y")
def kneser_ney_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kneser_ney(_pairs(spark, sf_dir), grouped=True)[0].withColumn("log_p", F.round("log_p", 5))


@query(f"""WITH {_KN}, h AS (SELECT p.x, p.y, ln(greatest(n - ({_CUT}), 0) / total + gamma * pr) AS lp FROM p, d, c, lo WHERE c.x = p.x AND lo.y = p.y),
    e AS (SELECT item_id, w[k] AS x, w[k + 1] AS y FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM (SELECT item_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark)))
    SELECT item_id AS id, count(*) AS n_pairs, round(sum(coalesce(h.lp, ln(lo.pr) + coalesce(ln(c.gamma), 0), -100)), 3) AS log_prob FROM e LEFT JOIN h ON h.x = e.x AND h.y = e.y LEFT JOIN c ON c.x = e.x LEFT JOIN lo ON lo.y = e.y GROUP BY item_id""")
def kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "benchmark")
    model = stats.kneser_ney(_pairs(spark, sf_dir), grouped=True, only=stats.row_pairs(texts, "item_id", "text"))
    return stats.kn_scores(texts, "item_id", "text", model).withColumn("log_prob", F.round("log_prob", 3))


# --- vectors


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(r AS INT) AS rank, id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) WHERE r <= 10""")
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return similarity.most_similar(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding").withColumn("similarity", F.round("similarity", 5))


@query("""WITH c AS (SELECT label, list_transform(range(1, 65), lambda k: list_avg(list_transform(vs, lambda v: v[k]))) AS v FROM (SELECT label, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS vs FROM embeddings GROUP BY label))
    SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.v), 5) AS similarity FROM embeddings e JOIN c ON c.label = e.label""")
def vector_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector with the mean of its label."""
    e = _table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("mean"))
    return e.join(F.broadcast(mean), "label").select("vec_id", "label", F.round(similarity.cosine(F.col("embedding"), F.col("mean")), 5).alias("similarity"))


# --- morphemes: literal rows, since no table holds Hangul


def _expected(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM {_values(rows, names)}"


READINGS = [
    ("나는 학교에 갔다.", "나/NP 는/JX 학교/NNG 에/JKB 가/VV 었/EP 다/EF ./SF"), ("사람이 밥을 먹었다", "사람/NNG 이/JKS 밥/NNG 을/JKO 먹/VV 었/EP 다/EF"), ("친구가 책을 읽습니다.", "친구/NNG 가/JKS 책/NNG 을/JKO 읽/VV 습니다/EF ./SF"),
    ("날씨가 아름다워요", "날씨/NNG 가/JKS 아름답/VA-I 어요/EF"), ("물을 마셔요", "물/NNG 을/JKO 마시/VV 어요/EF"), ("나무를 봤다", "나무/NNG 를/JKO 보/VV 었/EP 다/EF"), ("뷁뷁이 좋다", "뷁뷁/NNG 이/JKS 좋/VA 다/EF"), ("010-1234-5678", "010-1234-5678/W_SERIAL"),
]


def _readings(spark: SparkSession) -> DataFrame:
    return analyzer.analyze(_rows(spark, [(t,) for t, _ in READINGS], "text string"), "text", "text")


def _written(tokens: str) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(t.form, F.lit("/"), t.tag)), " ")


@query(_expected(READINGS, "text, reading"))
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reading of each text."""
    return _readings(spark).select(F.col("id").alias("text"), _written("tokens").alias("reading"))


@query()
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: tokens by tag of each (symbols, letters, numbers, patterns, sentences)."""
    d = _docs(spark, sf_dir)
    return analyzer.analyze(d, "doc_id", "text").select("id", F.size("tokens").alias("n_tokens"), (F.coalesce(F.array_max(F.transform("tokens", lambda t: t.sent_position)), F.lit(-1)) + 1).alias("n_sentences"))


SPLIT = [("나는 갔다. 너는 왔다.", 0, 0, 6), ("나는 갔다. 너는 왔다.", 1, 7, 13), ("밥을 먹었다", 0, 0, 6)]


@query(_expected(SPLIT, 'id, sent_position, "begin", "end"'))
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzer.sentences(analyzer.analyze(_rows(spark, [(t,) for t in dict.fromkeys(s[0] for s in SPLIT)], "text string"), "text", "text"))


JOINED = [("공부했다", "공부하/VV 었/EP 다/EF"), ("사람들이", "사람들/NNG 이/JKS")]


@query(_expected(JOINED, "text, reading"))
def affix_joining(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = analyzer.Options(match=patterns.Match.ALL | patterns.Match.JOIN_AFFIX)
    return analyzer.analyze(_rows(spark, [(t,) for t, _ in JOINED], "text string"), "text", "text", options=options).select(F.col("id").alias("text"), _written("tokens").alias("reading"))


COMBINED = [("하", "VV", "었", "EP", "했"), ("이르", "VV", "어", "EC", "일러"), ("이르", "VV-I", "어", "EC", "이르러"), ("돕", "VV", "어", "EC", "도와"), ("묻", "VV-I", "어", "EC", "물어"), ("묻", "VV", "어", "EC", "묻어"), ("나", "NP", "가", "JKS", "내가"), ("배우", "VV", "었", "EP", "배웠"), ("하얗", "VA-I", "어", "EC", "하얘"), ("먹", "VV", "면", "EC", "먹으면"), ("바닥", "NNG", "가", "JKS", "바닥이")]


@query(_expected(COMBINED, "l, lt, r, rt, written"))
def morpheme_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rows(spark, [x[:4] for x in COMBINED], "l string, lt string, r string, rt string")
    return c.withColumn("written", combiner.combined(F.col("l"), F.col("lt"), F.col("r"), F.col("rt")))


@query(_expected([(t,) for t, _ in READINGS], "text"))
def analyze_and_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from their morphemes; sentences of one word after another come back as they were."""
    return _readings(spark).select(combiner.join_tokens(F.transform("tokens", lambda t: F.struct(t.form.alias("form"), t.tag.alias("tag")))).alias("text"))


VARIANTS = [("개가납네", "개가납네", 0.0), ("개가납네", "게가납네", 1.0), ("개가납네", "개가납내", 1.0), ("개가납네", "게가납내", 2.0), ("사에", "사에", 0.0), ("사에", "사레", 1.0), ("사에", "사애", 1.0), ("%없어", "%없어", 0.0)]


@query("SELECT id, variant, CAST(cost AS DOUBLE) AS cost FROM (" + _expected(VARIANTS, "id, variant, cost") + ")")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = typos.TypoSet().add("ㅐ", "ㅔ").add("ㅔ", "ㅐ").add("사에", "사레")
    return typos.typo_variants(_rows(spark, [(t,) for t in dict.fromkeys(v[0] for v in VARIANTS)], "t string"), "t", "t", rules, 2)


@query("SELECT item_id AS id, text FROM benchmark")
def subword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as subword ids and back: a vocabulary of the ASCII letters and bytes."""
    letters = [chr(c) for c in range(33, 127)]
    s = subword.Subword(subword.with_bytes([*[(c, None, "word", -5.0) for c in letters], *[(c, None, "piece", -5.0) for c in letters]]))
    return subword.decode(subword.encode(_table(spark, sf_dir, "benchmark"), "item_id", "text", s), "id", "ids", s)


@query("SELECT * FROM (VALUES (0.8::DOUBLE, 0.8::DOUBLE, 2::BIGINT)) AS v(micro, macro, rows)")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = "array<struct<form:string,tag:string>>"
    row = [("밥", "NNG"), ("을", "JKO"), ("먹", "VV"), ("았", "EP"), ("다", "EF")], [("밥", "NNG"), ("를", "JKO"), ("먹", "VV"), ("었", "EP")]
    return evaluation.summary(evaluation.morph_scores(_rows(spark, [(1, *row), (2, *row)], f"id int, g {token}, f {token}"), "id", "g", "f"))


@query("SELECT surface, tag, count(*) AS n FROM (SELECT unnest(surfaces) AS surface, tag FROM (VALUES (['학교', '책'], 'NNG'), (['을', '를'], 'JKO'), (['을'], 'ETM')) AS v(surfaces, tag)) GROUP BY surface, tag")
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact look-up of forms: a join with the lexicon."""
    asked = _rows(spark, [("학교",), ("책",), ("을",), ("를",), ("없는말",)], "surface string")
    entries = lexicon.starter(spark).where("size(analysis) = 1").select("surface", F.col("analysis")[0].tag.alias("tag"))
    return asked.join(F.broadcast(entries), "surface").groupBy("surface", "tag").agg(F.count("*").alias("n"))


@query("SELECT item_id AS id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(w)) AS BIGINT) AS covered FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')) AS w FROM benchmark) JOIN (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')) AS word FROM conversations)) ON w = word GROUP BY item_id")
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each benchmark item that the conversations have."""
    known = _table(spark, sf_dir, "conversations").select(F.explode(stats.tokens(F.col("text"))).alias("word")).distinct()
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(stats.tokens(F.col("text"))).alias("word"))
    return asked.join(known, "word", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("word")).cast("bigint").alias("covered"))


@query("""SELECT CAST(epoch(time_bucket(INTERVAL '10 minutes', ts)) AS BIGINT) AS "begin", event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming counts over the whole events table."""
    w = streams.windowed_counts(_table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return w.select(F.unix_timestamp("begin").alias("begin"), "key", "n", F.round("total", 4).alias("total"))


# --- intervals, contexts, samples


@query("SELECT page_id, \"begin\", \"end\", outer_begin, outer_end FROM (SELECT page_id, k AS \"begin\", k + 2 AS \"end\" FROM (SELECT page_id, unnest(range(0, 20, 3)) AS k FROM pages)) JOIN (SELECT page_id, page_id % 7 AS outer_begin, page_id % 7 + 9 AS outer_end FROM pages) USING (page_id) WHERE outer_begin <= \"begin\" AND \"end\" <= outer_end")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id")
    inner = p.select("page_id", F.explode(F.sequence(*(F.lit(k).cast("bigint") for k in (0, 18, 3)))).alias("begin")).withColumn("end", F.col("begin") + 2)
    outer = p.select("page_id", (F.col("page_id") % 7).alias("begin"), (F.col("page_id") % 7 + 9).alias("end"))
    return intervals.contained(inner, outer, "page_id")


@query("SELECT user_id, \"begin\", \"end\" FROM (SELECT *, max(\"end\") OVER (PARTITION BY user_id ORDER BY \"begin\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS \"begin\", CAST(floor(epoch(ts)) AS BIGINT) + 600 AS \"end\" FROM events)) WHERE \"begin\" < reach")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events less than ten minutes after an earlier one of the same user."""
    e = _table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("begin")).withColumn("end", F.col("begin") + 600)
    return intervals.overlapping(e, "user_id")


LATTICE = [("a", 0, 2), ("b", 0, 1), ("c", 2, 4), ("d", 3, 4), ("e", 4, 5)]


@query(_expected([("x", n, b, e) for n, b, e in LATTICE if n in "ace"], 'id, node, "begin", "end"'))
def lattice_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a way through the lattice."""
    nodes = _rows(spark, [("x", *n) for n in LATTICE], "id string, node string, begin int, end int")
    return intervals.useful(nodes, _rows(spark, [("x", 5)], "id string, size int"), "id")


@query(f"SELECT x, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) + 0.0 AS entropy FROM {_XY} GROUP BY x")
def context_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.contexts(_pairs(spark, sf_dir)).withColumn("entropy", F.round("entropy", 5) + F.lit(0.0))


@query(f"SELECT item_id AS id, w[k] AS target, array_to_string(w[greatest(k - 4, 1):k - 1], ' ') AS context FROM (SELECT item_id, w, unnest(range(2, len(w) + 1)) AS k FROM (SELECT item_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark))")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.windows(_table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("context", F.array_join("context", " "))


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 .,"


@query(f"SELECT item_id, array_to_string(list_transform(string_split(left(text, 100), ''), lambda c: CAST(instr('{_LETTERS}', c) AS VARCHAR)), ',') AS ids FROM benchmark")
def character_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(stats.chr_ids(F.left("text", F.lit(100)), _LETTERS), lambda x: x.cast("string")), ",").alias("ids"))


OFFSETS = [("a한😀b", k) for k in range(5)]


@query(f"SELECT t, k, {chars.byte_offset('t', 'k', True)} AS bytes, {chars.utf16_offset('t', 'k', True)} AS units FROM {_values(OFFSETS, 't, k')}")
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, OFFSETS, "t string, k int").select("t", "k", F.expr(chars.byte_offset("t", "k")).cast("bigint").alias("bytes"), F.expr(chars.utf16_offset("t", "k")).cast("bigint").alias("units"))


PARTS = [("a,b,,c", "a|b,c"), ("", ""), (",", "|")]


@query(_expected(PARTS, "t, parts"))
def escaped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t,) for t, _ in PARTS], "t string").select("t", F.array_join(chars.split_escaped(F.col("t"), ","), "|").alias("parts"))


@query(f"""WITH w AS (SELECT regexp_extract_all(text, '{WORD}') AS w FROM benchmark), a AS (SELECT w, unnest(range(1, len(w))) AS a FROM w), p AS (SELECT w[a] AS x, w[a + d] AS y FROM (SELECT w, a, unnest(range(1, least(8, len(w) - a) + 1)) AS d FROM a)),
    c AS MATERIALIZED (SELECT x, y, count(*) AS n FROM p GROUP BY x, y), l AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), r AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), t AS (SELECT sum(n) AS t FROM c)
    SELECT c.x, c.y, n, round(ln(n * t / CAST(nx * ny AS DOUBLE)), 5) + 0.0 AS pmi FROM c, l, r, t WHERE n >= 2 AND l.x = c.x AND r.y = c.y""")
def skip_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.skip_pairs(_table(spark, sf_dir, "benchmark"), "text", least=2).withColumn("pmi", F.round("pmi", 5) + F.lit(0.0))


@query(f"""WITH g AS MATERIALIZED (SELECT gram, row_number() OVER (ORDER BY gram) AS context_id FROM (SELECT array_to_string(w[a:a + k - 1], ' ') AS gram FROM (SELECT w, a, unnest(range(1, least(len(w) - a + 1, 3) + 1)) AS k FROM (SELECT w, unnest(range(1, len(w) + 1)) AS a FROM (SELECT regexp_extract_all(text, '{WORD}') AS w FROM conversations))) GROUP BY gram HAVING count(*) >= 5)),
    e AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT item_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark)), m AS (SELECT item_id, k, unnest(range(1, least(k, 3) + 1)) AS m, w FROM e)
    SELECT item_id AS id, CAST(k - 1 AS INT) AS place, arg_max(context_id, m) FILTER (context_id IS NOT NULL) AS context_id FROM (SELECT item_id, k, m, context_id FROM m LEFT JOIN g ON g.gram = array_to_string(w[k - m + 1:k], ' ')) GROUP BY item_id, k""")
def longest_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stats.numbered(stats.prefix_counts(_table(spark, sf_dir, "conversations"), "text"), F.asc("gram")).select("gram", (F.col("number") + 1).cast("bigint").alias("context_id"))
    return stats.context_ids(_table(spark, sf_dir, "benchmark"), "item_id", "text", known)
