"""Secret scan with corpus-wide ownership frequency.

Built-in expressions find candidates (known key formats and values assigned to names such as token or password) in whole texts. A private key's value is its body, without what stands around it
and without white space. Each candidate's value is hashed (md5; the value itself leaves the scan nowhere) and counted over the corpus by its hash alone, whatever it was found as: documents, repositories (the source) and
owners (the source up to its first slash). The kind follows from the value, so that a key is of one kind bare or assigned. Texts are scanned once: hits are written, then counted. Verdicts:

* placeholder: the value says so (example, sample, changeme, xxxx, 1234567, ...) or has fewer than LEAST_DISTINCT different characters;
* copied: at least WIDE owners have it: a documentation example that spreads, not somebody's key;
* live: anything else, owner-specific and random-looking.

Defined cases: a private key without an end goes up to the first character that neither keys nor their headers have; one without a body is the placeholder it says it is; null or empty texts have no candidates; a null source is the source "" and one owner; a value that a document has several times is one finding with its number of
occurrences; rows that repeat count once as documents; a null doc_id is reported and counts as one document. Extra columns stay and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: kind -> expression. Understood alike by Java and RE2.
KINDS = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "stripe": r"[sr]k_live_[0-9A-Za-z]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
ASSIGNED = r"""(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|[Aa]pi_?[Kk]ey|API_?KEY|[Aa]ccess_?[Kk]ey|ACCESS_?KEY)["']?[ ]{0,3}[:=]{1,2}[ ]{0,3}["']?[A-Za-z0-9_/+=.~-]{16,}"""
#: What an assignment begins with, up to the value.
ASSIGNMENT = r"""^[A-Za-z_]+["']?[ ]{0,3}[:=]{1,2}[ ]{0,3}["']?"""
EVERY = "|".join([*KINDS.values(), ASSIGNED])
#: A private key from its first line up to a character that no key has; found on its own, so that it hides nothing that follows. Single character classes only: no length makes a matcher recurse.
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\\s:,-]*"
#: Each expression needs one of these.
QUICK = r"AKIA|gh[pousr]_|xox[abprs]-|AIza|k_live_|eyJ|-----BEGIN|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assw|PASSWORD|[Kk]ey|KEY"
#: What isn't the key itself: the frame, headers and white space.
PEM_FRAME = r"^-----BEGIN [A-Z ]*-----|-----END[\s\S]*$|[A-Za-z-]{1,20}: [^\n\\]{0,80}(?:\\[nr]|\s)|\\[nr]|\s"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|1234567|abcdefg|0000000"
WIDE = 3
LEAST_DISTINCT = 8


def _kind(value: str) -> str:
    """The kind of a value, the assignment being removed."""
    tests = [f"WHEN regexp_matches({value}, {_quoted('^(?:' + x + ')$')}) THEN '{k}'" for k, x in KINDS.items()]
    return f"CASE WHEN substr({value}, 1, 10) = '-----BEGIN' THEN 'pem' " + " ".join(tests) + " ELSE 'assigned' END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def kind(value: Column) -> Column:
    out = F.when(F.startswith(value, F.lit("-----BEGIN")), F.lit("pem"))
    for k, x in KINDS.items():
        out = out.when(F.rlike(value, F.lit("^(?:" + x + ")$")), F.lit(k))
    return out.otherwise(F.lit("assigned"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, repo, owner, kind, secret (md5), fake (placeholder or too plain): one row for each occurrence."""
    text = text_or_empty(text_col)
    # most texts hold none of the words that every expression has one of: one quick look before the whole expression
    found = docs.where(F.rlike(text, F.lit(QUICK))).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("repo"), F.explode(F.concat(F.regexp_extract_all(text, F.lit(EVERY), F.lit(0)), F.regexp_extract_all(text, F.lit(PEM), F.lit(0)))).alias("hit"))
    bare = found.withColumn("bare", F.when(F.startswith("hit", F.lit("-----BEGIN")), F.col("hit")).otherwise(F.regexp_replace("hit", ASSIGNMENT, "")))
    value = bare.withColumn("kind", kind(F.col("bare"))).withColumn("value", F.when(F.col("kind") == "pem", F.regexp_replace("bare", PEM_FRAME, "")).otherwise(F.col("bare")))
    fake = (F.size(F.array_distinct(F.split("value", ""))) < LEAST_DISTINCT) | F.rlike("value", F.lit(PLACEHOLDER))
    return value.select("doc_id", "repo", F.split_part("repo", F.lit("/"), F.lit(1)).alias("owner"), "kind", F.md5("value").alias("secret"), fake.alias("fake"))


def findings(docs: DataFrame, wide: int = WIDE, **columns) -> DataFrame:
    """doc_id, repo, kind, secret, occurrences, documents, repos, owners, verdict: one row for each document (and source) and value. Only hits are shuffled."""
    each = written(candidates(docs, **columns).groupBy("secret", "kind", "doc_id", "repo", "owner").agg(F.count("*").alias("occurrences"), F.first("fake").alias("fake")), "secrets")
    known = each.groupBy("secret").agg(F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("documents"), F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    verdict = F.when(F.col("fake"), "placeholder").when(F.col("owners") >= wide, "copied").otherwise("live")
    return each.join(known, "secret").select("doc_id", "repo", "kind", "secret", "occurrences", "documents", "repos", "owners", verdict.alias("verdict"))


ORACLE = f"""
WITH hits AS (SELECT doc_id, coalesce(source, '') AS repo, unnest(regexp_extract_all(coalesce(text, ''), {_quoted(EVERY)}) || regexp_extract_all(coalesce(text, ''), {_quoted(PEM)})) AS hit FROM documents),
kinds AS (SELECT *, {_kind("bare")} AS kind FROM (SELECT *, CASE WHEN starts_with(hit, '-----BEGIN') THEN hit ELSE regexp_replace(hit, {_quoted(ASSIGNMENT)}, '') END AS bare FROM hits)),
vals AS (SELECT *, CASE WHEN kind = 'pem' THEN regexp_replace(bare, {_quoted(PEM_FRAME)}, '', 'g') ELSE bare END AS value FROM kinds),
e AS (SELECT md5(value) AS secret, kind, doc_id, repo, split_part(repo, '/', 1) AS owner, count(*) AS occurrences,
      bool_or(len(list_distinct(string_split(value, ''))) < {LEAST_DISTINCT} OR regexp_matches(value, {_quoted(PLACEHOLDER)})) AS fake FROM vals GROUP BY ALL),
k AS (SELECT secret, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS documents, count(DISTINCT repo) AS repos, count(DISTINCT owner) AS owners FROM e GROUP BY ALL)
SELECT doc_id, repo, kind, secret, occurrences, documents, repos, owners, CASE WHEN fake THEN 'placeholder' WHEN owners >= {WIDE} THEN 'copied' ELSE 'live' END AS verdict
FROM e JOIN k USING (secret)"""
