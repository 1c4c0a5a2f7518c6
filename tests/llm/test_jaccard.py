import random
import re
from collections import Counter

import corpus_pipeline as p
from shoebox.llm import common as c
from shoebox.llm import jaccard
from shoebox.llm.jaccard import similar_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(rows):
    """(doc_id, component_id) of every row, from the Jaccard similarities of all pairs."""
    sets = sorted({shingles(t) for d, t in rows if d is not None}, key=len)
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both * 5 >= 4 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    group = {s: x for s, x in zip(sets, label)}
    least = {}
    for d, t in rows:
        if d is not None:
            x = group[shingles(t)]
            least[x] = min(least.get(x, d), d)
    return [(d, least.get(group.get(shingles(t)))) for d, t in rows]


def near_copies(n=150):
    """Copies of one text with a few changed words, texts with one line in common, and long ones of unlike lengths."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(3000)}"
    base, line, long = [word() for _ in range(120)], [word() for _ in range(30)], [word() for _ in range(3000)]
    texts = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(120), k % 6):
            text[at] = word()
        texts += [" ".join(text), " ".join([word() for _ in range(rng.randrange(60))] + line)]
    texts += [" ".join(long[: 3000 - 130 * k]) for k in range(12)]
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    rows = near_copies()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 20 < len({k for _, k in want}) < len(rows) - 100
    for options in ({}, {"chunk": 8, "chunk_shingles": 900, "sample": 1}):
        assert Counter(map(tuple, similar_texts(docs, **options).collect())) == Counter(want)


def test_odd_rows(odd_docs, no_docs):
    assert Counter(map(tuple, similar_texts(odd_docs).collect())) == Counter(brute([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert similar_texts(no_docs).collect() == []


def test_stage_keeps_one_of_each_group(spark, sf):
    docs = c.documents(spark, sf)
    want = {d for d, k in brute([(r.doc_id, r.text) for r in docs.collect()]) if d == k}
    kept = p.keep_one_of_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert 1 in want and 177 not in want  # similarity 0.83, yet 9 bits of SimHash apart


def test_simhash_finds_its_links_before_the_keys_do(spark, sf, monkeypatch):
    """Long texts with one word changed have one fingerprint or are a few bits apart: SimHash joins five pairs, and only the sixth
    is left to the keys."""
    rng = random.Random(9)
    rows, compared, joined = [], [], []
    for k in range(6):
        words = [f"u{rng.randrange(5000)}" for _ in range(600)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-1] + ["other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    in_blocks, links = jaccard._compared, jaccard.near_links
    monkeypatch.setattr(jaccard, "_compared", lambda rows, parts, by: (compared.append((by is jaccard._block, rows.count())), in_blocks(rows, parts, by))[1])
    monkeypatch.setattr(jaccard, "near_links", lambda nodes: (joined.append(links(nodes).distinct().count()), links(nodes))[1])
    assert Counter(map(tuple, p.similar_texts(docs).collect())) == Counter(brute(rows))
    assert joined[0] > 0 and compared == [(False, 10), (True, 2), (False, 2)]
