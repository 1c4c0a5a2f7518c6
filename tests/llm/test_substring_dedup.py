import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from shoebox.llm import common as c
from shoebox.llm.substring_dedup import FingerprintIndex, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    first, out = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_equals_brute_force(spark, sf):
    docs = c.documents(spark, sf)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sum(k[2] * n for k, n in want.items()) > 0
    assert Counter(map(tuple, substring_dedup(docs).collect())) == want


def test_odd_rows_and_any_number_of_batches(odd_docs):
    want = brute([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    for batches in (1, 4):
        assert Counter(map(tuple, substring_dedup(odd_docs, batches=batches).collect())) == want


def test_kept_text(odd_docs):
    got = {(r.doc_id, r.n_words): r for r in substring_dedup(odd_docs, with_text=True).collect()}
    assert got[3, 300].kept_text == ""
    assert got[6, 0].kept_text == " \n\t "


def test_empty_table(no_docs):
    assert substring_dedup(no_docs).collect() == []


def test_index_keeps_the_first_document_whatever_the_order_of_batches(spark):
    rows = [(1, 1, 7, 5), (1, 2, 7, 6), (2, 1, 7, 9), (2, 1, 8, 9)]
    index = FingerprintIndex(spark, fanout=1)
    for later in (0, 10, -3):
        index.add(spark.createDataFrame([(a, s, k, d + later) for a, s, k, d in rows], "anchor long, segment long, check long, doc_id long"))
    assert len(index.runs) == 1
    assert {tuple(r) for r in index.rows().collect()} == {(1, 1, 7, 2), (1, 2, 7, 3), (2, 1, 7, 6), (2, 1, 8, 6)}
    assert index.rows().groupBy("anchor", "segment", "check").agg(F.count("*").alias("n")).where("n > 1").count() == 0
    again = FingerprintIndex(spark, index.root, fanout=3)
    assert {tuple(r) for r in again.rows().collect()} == {tuple(r) for r in index.rows().collect()}
    again.add(spark.createDataFrame([(1, 1, 7, 1), (5, 5, 5, 40)], "anchor long, segment long, check long, doc_id long"))
    assert len(again.runs) == 2 and again.runs[1][0].count() == 2
    assert {tuple(r) for r in FingerprintIndex(spark, index.root).rows().collect()} >= {(1, 1, 7, 1), (5, 5, 5, 40), (1, 2, 7, 3)}


def test_patterns_and_wide_ids(spark):
    """Words that a polynomial hash takes for equal, and ids as far apart as longs can be."""
    pattern = [0]
    while len(pattern) < 1024:
        pattern += [1 - x for x in pattern]
    words = [f"w{k}" for k in range(60)]
    odd = ["".join(letters[x] for x in pattern) for letters in ("ab", "ba")]
    rows = [(k + 1, " ".join([*words[:30], x, *words[30:]])) for k, x in enumerate(odd)]
    rows += [(3, " ".join("ab"[x] for x in pattern)), (4, " ".join("ba"[x] for x in pattern))]
    rows += [(-(2**62) - 5, " ".join(f"v{k}" for k in range(60))), (2**62 + 5, " ".join(f"v{k}" for k in range(60)))]
    rows += [(2**63 - 1, " ".join(words)), (-(2**63), None), (9, "common " * 20 + " ".join(words[:50]) + " x y"), (10, "other " * 7 + " ".join(words[:50]) + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3):
        assert Counter(map(tuple, substring_dedup(docs, batches=batches).collect())) == brute(rows)


def test_segments_and_index_are_deleted(spark, sf, tmp_path, monkeypatch):
    """When the marks are stored, neither the segments nor a run of the index is left on the disk."""
    docs = c.documents(spark, sf)
    monkeypatch.setattr(c, "shared_dir", lambda spark: str(tmp_path))
    out = substring_dedup(docs)
    assert {p.name for p in tmp_path.iterdir()} == {"marks", "windows", "repeated"} and out.count() == docs.count()


def test_compaction_deletes_the_former_runs(spark):
    index = FingerprintIndex(spark, fanout=1)
    for k in range(3):
        index.add(spark.createDataFrame([(k, k, k, k)], "anchor long, segment long, check long, doc_id long"))
    again = FingerprintIndex(spark, index.root)
    files = {r.f.rsplit("/", 2)[1] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{index.root}/fingerprint_run_*").selectExpr("input_file_name() AS f").collect()}
    assert len(files) == 1 and again.rows().count() == 3
