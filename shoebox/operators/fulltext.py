"""A stored full-text index: postings with places, sorted by term, and the current run of each text.

Texts are tokenised once, when they are indexed. Indexing texts again adds a run of postings, and the old ones of the
same texts no longer count, as a posting must be of its text's current run. A query reads the postings of its terms.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bm25_score, query_words, tokens

POSTINGS = "term string, photo_id long, places array<int>, run string"
TEXTS = "seq long, photo_id long, dl int, run string"


def _starts(term: str, step: int) -> Column:
    """Where a phrase would start that has the term ``step`` places later."""
    return F.transform(F.try_element_at(F.col("m"), F.lit(term)), lambda x: x - step)


class FullTextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _current(self) -> DataFrame:
        """(photo_id, dl, run): the newest entry of each text; texts that were taken out have no dl."""
        last = self._read("texts", TEXTS).groupBy("photo_id").agg(F.max_by(F.struct("dl", "run"), "seq").alias("r"))
        return last.select("photo_id", "r.dl", "r.run").where("dl IS NOT NULL")

    def replace(self, photo_ids: DataFrame, texts: DataFrame) -> None:
        """The texts (photo_id, text) take the place of what the index has of ``photo_ids`` (photo_id); blank ones aren't kept."""
        run = uuid.uuid4().hex
        seq = (self._read("texts", TEXTS).agg(F.max("seq")).first()[0] or 0) + 1
        rows = texts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("photo_id", tokens("text").alias("t"))
        places = rows.select("photo_id", F.posexplode("t").alias("place", "term")).groupBy("term", "photo_id").agg(F.sort_array(F.collect_list("place")).alias("places"))  # of one text
        places.withColumn("run", F.lit(run)).repartitionByRange("term", "photo_id").sortWithinPartitions("term").write.mode("append").parquet(f"{self.root}/postings")
        known = rows.select("photo_id", F.size("t").alias("dl"))
        gone = photo_ids.select("photo_id").distinct().join(known.select("photo_id"), "photo_id", "left_anti").withColumn("dl", F.lit(None).cast("int"))
        every = known.unionByName(gone).select(F.lit(seq).cast("long").alias("seq"), "photo_id", "dl", F.lit(run).alias("run"))
        every.write.mode("append").parquet(f"{self.root}/texts")

    def add(self, texts: DataFrame) -> None:
        self.replace(texts.select("photo_id"), texts)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """(photo_id, score) by BM25, best (lowest) first; the same rows as text.bm25 over the current texts."""
        words = query_words(query)
        current = self._current()
        if not words:
            return current.select("photo_id", F.lit(0.0).alias("score")).where("false")
        phrases = sorted({tuple(w) for w in words})
        found = self._read("postings", POSTINGS).where(F.col("term").isin(sorted({t for p in phrases for t in p})))
        found = found.join(current, ["photo_id", "run"])
        by_text = found.groupBy("photo_id", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))  # the query's terms
        counts = []
        for k, phrase in enumerate(phrases):
            starts = _starts(phrase[0], 0)
            for step, term in enumerate(phrase[1:], 1):
                starts = F.array_intersect(starts, _starts(term, step))
            counts.append(F.coalesce(F.size(starts), F.lit(0)).alias(f"tf{k}"))
        rows = by_text.select("photo_id", "dl", *(F.when(c_ > 0, c_).otherwise(0).alias(f"tf{k}") for k, c_ in enumerate(counts)))
        stats = current.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl")).crossJoin(rows.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(phrases)))))  # one row
        scored = rows.where(" OR ".join(f"tf{k} > 0" for k in range(len(phrases)))).crossJoin(F.broadcast(stats))
        out = scored.select("photo_id", bm25_score(phrases, words).alias("score")).orderBy("score", "photo_id")
        return out.limit(limit) if limit is not None else out
