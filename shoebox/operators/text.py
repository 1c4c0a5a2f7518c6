"""Full text: tokens, postings and BM25, with the arithmetic of the usual embedded full-text index.

score(d) = sum over query words of -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), idf = ln((N - n + 0.5) / (n + 0.5)),
1e-6 where that isn't positive. Lower is better. A query word given twice counts twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

TOKEN = r"[\p{L}\p{N}]+"
WORD = re.compile(r"[^\W_]+")


def fold_text(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(ch))


def folded(text: Column | str) -> Column:
    """fold_text as a column, by Arrow batches; the stored index does this once per text (fulltext.py)."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.lower() if t.isascii() else fold_text(t))

    return fold(F.col(text) if isinstance(text, str) else text)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def query_words(query: str) -> list[list[str]] | None:
    """Words of a query, each as the tokens that the index makes of it ('foo_bar' is a phrase of two); None without words."""
    words = re.findall(r"\w+", query)
    found = [re.findall(r"[^\W_]+", fold_text(w)) for w in words]
    return [f for f in found if f] or None


def phrase_counts(text: str, phrases: list[tuple[str, ...]]) -> list[int]:
    """The number of tokens, and how often each phrase stands in them."""
    found = WORD.findall(text.lower() if text.isascii() else fold_text(text))
    times = Counter(found)
    out = [len(found)]
    for p in phrases:
        if len(p) == 1 or not all(w in times for w in p):
            out.append(times[p[0]] if len(p) == 1 else 0)
        else:
            out.append(sum(tuple(found[i : i + len(p)]) == p for i in range(len(found) - len(p) + 1)))
    return out


def postings(texts: DataFrame, key: str = "photo_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl) of an inverted index."""
    rows = texts.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(key, tokens(text).alias("t"))
    return rows.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def bm25_score(phrases: list[tuple[str, ...]], words: list[list[str]]) -> Column:
    """The score from the columns dl, N, avgdl, and tf and n with the number of each phrase; each counts as often as the
    query has it."""
    score = F.lit(0.0)
    for k, phrase in enumerate(phrases):
        idf = F.log((F.col("N") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        tf = F.col(f"tf{k}")
        one = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
        score = score - one * sum(tuple(w) == phrase for w in words)
    return score


def bm25(texts: DataFrame, query: str, limit: int | None = None, key: str = "photo_id", text: str = "text") -> DataFrame:
    """(key, score) of the texts with any word of the query, best (lowest) first, equal ones by key.

    One Arrow pass counts the query's phrases in each text, with dl, and the narrow counts are stored; N, avgdl and n come
    from them, and so do the scores. No posting list is shuffled.
    """
    words = query_words(query)
    rows = texts.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    if not words:
        return rows.select(key, F.lit(0.0).alias("score")).where("false")
    distinct = sorted({tuple(w) for w in words})
    size = len(distinct)

    @F.pandas_udf("array<int>")
    def counts(column: pd.Series) -> pd.Series:
        return column.map(lambda t: phrase_counts(t, distinct))

    found = rows.select(key, counts(text).alias("c"))
    rows = stored(found.select(key, F.get("c", 0).alias("dl"), *(F.get("c", k + 1).alias(f"tf{k}") for k in range(size))))
    stats = rows.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(size)))
    scored = rows.where(" OR ".join(f"tf{k} > 0" for k in range(size))).crossJoin(F.broadcast(stats))  # one row
    found = scored.select(key, bm25_score(distinct, words).alias("score")).orderBy("score", key)
    return found.limit(limit) if limit is not None else found


def combined_text(regions: DataFrame, by: str = "photo_id", order: str = "ord", text: str = "text") -> DataFrame:
    """(by, text): the regions' texts in order, one per line."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return regions.groupBy(by).agg(F.array_join(F.transform(parts, lambda s: s[text]), "\n").alias("text"))


def kept_regions(regions: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Regions with enough confidence and a text; the y axis turned from bottom up to top down."""
    rows = regions.where((F.col("conf") >= min_conf) & (F.trim("text") != ""))
    return rows.withColumn("by", 1 - (F.col("by") + F.col("bh")))
