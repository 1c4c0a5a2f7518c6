"""A corpus pipeline out of the corpus operators: each stage works on what the one before it kept.

The stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import common as c
from shoebox.llm.bpe import bpe_round_trip
from shoebox.llm.decontaminate import without_leaks
from shoebox.llm.jaccard import similar_texts
from shoebox.llm.quality import accepted, fit_quality
from shoebox.llm.substring_dedup import substring_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    c.short_batches(spark)
    return accepted(docs, fit_quality(docs, c.labels(spark, sf_dir)))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity 0.8 or more; by SimHash, and by keys where that
    doesn't reach) the document with the smallest doc_id stays; rows without an id stay."""
    found = similar_texts(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").subtract(found.where("doc_id = component_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go; documents of which nothing is left go with them."""
    cut = substring_dedup(docs, with_text=True, carry=True).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    columns = {
        "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType),
        "text": F.col("kept_text"),
        "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("in_n_chars")) if "n_chars" in docs.columns else None,
    }
    return cut.select(*((columns[n] if n in columns else F.col(f"`in_{n}`")).alias(n) for n in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return without_leaks(docs, c.benchmark(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, and the digests of ids and decoded text."""
    return bpe_round_trip(docs, ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]
#: SQL has no classifier and no BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = c.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = c.written(stage(spark, docs, sf_dir))
    return docs
