"""Licence scans by canonical digests.

A text's canonical form has lower case, no copyright lines, one spelling of words that are spelled in several ways,
no punctuation and single spaces. Its SHA-256 is looked up among the digests of the known licences: whole texts, with
and without the titles above them, by a hash join with that table, whose size is fixed; single lines, which may be notices, by a lookup in the same digests.
Everything is DataFrame functions; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import DIGESTS, LICENCES, NOTICES, TITLES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Equivalent spellings, replaced in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("&", " and "),
)
#: A line that opens with a copyright mark and goes on with a year, a mark or a blank to be filled in.
COPYRIGHT_LINE = r"(?:^|\n)[ \t*#/;-]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]|<|\[)|\(c\)[ \t]|©)[^\n]*"
RESERVED = r"all[ \t\r\n]+rights[ \t\r\n]+reserved\.?"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Every known notice has one of these after folding, and folding neither makes nor breaks them.
NOTICE_MARKS = ("licen", "rights reserved", "public domain", "cc0")


def _spelled(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fold(text: Column) -> Column:
    """Case, spellings, punctuation and spaces."""
    return F.trim(F.regexp_replace(_spelled(text), NOT_WORD, " "))


def canonical(text: Column) -> Column:
    """fold() without copyright lines and reservations of rights."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, " ")
    return fold(F.regexp_replace(out, RESERVED, " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the texts that are known word for word, bare and under their titles."""
    return [(k, f"{title}\n\n{t}".strip()) for k, t in LICENCES.items() for title in ("", *TITLES.get(k, ()))]


def known_digests(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(known_digest, licence) of the whole texts, and the digests of the notices; made by the same expressions."""
    spark = docs.sparkSession
    texts = spark.createDataFrame([("text", k, t) for k, t in whole_texts()] + [("notice", k, t) for k, t in NOTICES], "kind string, licence string, text string")
    rows = texts.select("kind", "licence", digest(F.when(F.col("kind") == "text", canonical(F.col("text"))).otherwise(fold(F.col("text")))).alias("known_digest")).collect()
    table = DIGESTS | {r.known_digest: r.licence for r in rows if r.kind == "text"} | {r.known_digest: r.licence for r in rows if r.kind == "notice"}
    return spark.createDataFrame(sorted(table.items()), "known_digest string, licence string"), {r.known_digest: r.licence for r in rows if r.kind == "notice"}


def licence_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): canonical_sha256, licence of the whole text or null, and notices, the sorted
    names of the licences that single lines name, joined by commas ('' if none), with n_notices.

    Null texts count as empty. A text of nothing but a known notice has that notice's licence. Repeated rows and null
    ids are handled like any other. Other columns are ignored.
    """
    known, notices = known_digests(docs)
    lookup = F.create_map(*(F.lit(x) for pair in sorted(notices.items()) for x in pair))
    marked = lambda line: F.exists(F.array(*map(F.lit, NOTICE_MARKS)), lambda m: F.contains(F.translate(line, UPPER, LOWER), m))
    lines = F.filter(F.split(F.col("text"), "\n"), marked)
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda line: F.try_element_at(lookup, digest(fold(line)))), lambda x: x.isNotNull())))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The canonical form is a column of its own, used twice: Spark computes it once.
    rows = rows.select("doc_id", "text", canonical(F.col("text")).alias("bare"), found.alias("found"))
    whole = digest(F.when(F.col("bare") != "", F.col("bare")).otherwise(fold(F.col("text"))))
    rows = rows.select("doc_id", whole.alias("canonical_sha256"), "found")
    rows = rows.join(F.broadcast(known), F.col("canonical_sha256") == F.col("known_digest"), "left")
    return rows.select("doc_id", "canonical_sha256", "licence", F.size("found").cast("long").alias("n_notices"), F.array_join("found", ",").alias("notices"))


def licence_sql() -> str:
    """The same rows as DuckDB SQL."""

    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        for old, new in SPELLINGS:
            x = f"replace({x}, {quote(old)}, {quote(new)})"
        return x

    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    folded = lambda x: f"trim(regexp_replace({spelled(lower(x))}, '{NOT_WORD}', ' ', 'g'))"
    stripped = lambda x: f"regexp_replace(regexp_replace({lower(x)}, '{COPYRIGHT_LINE}', ' ', 'g'), '{RESERVED}', ' ', 'g')"
    texts = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in whole_texts())
    digests = ", ".join(f"({quote(d)}, {quote(k)})" for d, k in DIGESTS.items())
    notices = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in NOTICES)
    marks = " OR ".join(f"contains({lower('line')}, {quote(m)})" for m in NOTICE_MARKS)
    return f"""
WITH texts AS (SELECT sha256({folded(stripped('t'))}) AS known_digest, k AS licence FROM (VALUES {texts}) AS v(k, t)),
notices AS (SELECT sha256({folded('t')}) AS known_digest, k AS licence FROM (VALUES {notices}) AS v(k, t)),
known AS (SELECT * FROM notices UNION ALL (SELECT * FROM texts UNION SELECT * FROM (VALUES {digests}) AS v(known_digest, licence))),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
folds AS (SELECT n, doc_id, {folded(stripped('text'))} AS one, {folded('text')} AS two FROM docs),
whole AS (SELECT n, doc_id, sha256(CASE WHEN one <> '' THEN one ELSE two END) AS canonical_sha256 FROM folds),
lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (SELECT n, count(DISTINCT licence) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
          FROM (SELECT n, sha256({folded('line')}) AS d FROM lines WHERE {marks}) AS x JOIN notices ON d = known_digest GROUP BY n)
SELECT w.doc_id, w.canonical_sha256, k.licence, CAST(coalesce(f.n_notices, 0) AS BIGINT) AS n_notices, coalesce(f.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.canonical_sha256 = k.known_digest LEFT JOIN found f ON w.n = f.n
"""
