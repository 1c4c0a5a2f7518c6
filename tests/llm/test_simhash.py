import re
from collections import Counter

import numpy as np
import xxhash

from shoebox.llm import common as c
from shoebox.llm.simhash import link_block, near_duplicates, near_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """doc_id -> smallest reachable; prints: list of (doc_id, fingerprint)."""
    values = sorted({f for _, f in prints})
    label = {f: f for f in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:  # a fingerprint that only rows without an id have is no node
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in prints]


def test_equals_brute_force(spark, sf):
    docs = c.documents(spark, sf)
    want = components([(r.doc_id, fingerprint(r.text)) for r in docs.collect()])
    assert any(d != k for d, _, k in want)
    assert Counter(map(tuple, near_duplicates(docs).collect())) == Counter(want)


def test_odd_rows(odd_docs, no_docs):
    want = components([(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()])
    assert Counter(map(tuple, near_duplicates(odd_docs).collect())) == Counter(want)
    assert near_duplicates(no_docs).collect() == []


def test_blocks_against_all_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.array([int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for x in np.repeat(centre, 6)], np.uint64)
    groups = np.sort(rng.integers(0, 5, len(prints)))
    got = link_block(groups, prints)
    want = list(range(len(prints)))
    for _ in range(len(prints)):
        for i in range(len(prints)):
            for j in range(i):
                if groups[i] == groups[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 4:
                    want[i] = want[j] = min(want[i], want[j])
        if want == (want := [want[k] for k in want]):
            break
    assert got.tolist() == want


def test_split_blocks_lose_no_link(spark):
    """A dense group of distinct fingerprints, compared in many small chunks."""
    rng = np.random.default_rng(2)
    prints = {0x0123456789ABCDEF}
    at = 0x0123456789ABCDEF
    while len(prints) < 150:
        at ^= 1 << int(rng.integers(0, 64))
        prints.add(at)
    signed = [(k, int(np.array([p], np.uint64).view(np.int64)[0])) for k, p in enumerate(sorted(prints))]
    links = near_links(spark.createDataFrame(signed, "node long, print long"), chunk=16)
    joined = c.smallest_in_component(links)
    want = {d: k for d, _, k in components([(k, p) for k, p in enumerate(sorted(prints))])}
    got = {r.node: r.component for r in joined.collect()}
    assert {d: got.get(d, d) for d in want} == want
