import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoebox.llm import common as c
from shoebox.llm import katz
from shoebox.llm.katz import katz_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), ""]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


class BruteForce:
    """Katz over dictionaries, one history at a time, straight from the definition."""

    def __init__(self, texts):
        self.counts = [Counter(), Counter(), Counter()]
        for t in texts:
            w = ["<s>", "<s>", *tokens(t)]
            for i in range(2, len(w)):
                for n in range(3):
                    self.counts[n][tuple(w[i - n : i + 1])] += 1
        self.d = [katz.good_turing(Counter(k.values())) for k in self.counts]
        self.after = [defaultdict(dict) for _ in range(3)]
        for n in range(3):
            for gram, k in self.counts[n].items():
                self.after[n][gram[:-1]][gram[-1]] = k
        self.tokens = sum(self.counts[0].values())
        self.lost = sum(k * (1 - self.d[0][k]) for k in self.counts[0].values() if k <= 5)
        self.mass = max(self.tokens + (0 if self.lost > 0 else 0.5), 0.5)
        self.memo = {}

    def kept(self, n, k):
        return k if k > 5 else k * self.d[n][k]

    def history(self, n, h):
        """(divisor, alpha) of a history of n words."""
        if (n, h) not in self.memo:
            seen = self.after[n].get(h, {})
            if not seen:
                return 1.0, 1.0
            total, kept = sum(seen.values()), sum(self.kept(n, k) for k in seen.values())
            room = 1 - sum(self.p(n - 1, h[1:], w) for w in seen)
            if room <= 1e-12:
                self.memo[n, h] = kept, 0.0
            else:
                divisor = total + 0.5 if total - kept <= 1e-9 else total
                self.memo[n, h] = divisor, (1 - kept / divisor) / room
        return self.memo[n, h]

    def p(self, n, h, w):
        if n == 0:
            k = self.counts[0].get((w,), 0)
            return self.kept(0, k) / self.mass if k else (self.lost or 0.5) / self.mass
        k = self.counts[n].get((*h, w), 0)
        divisor, alpha = self.history(n, h)
        return self.kept(n, k) / divisor if k else alpha * self.p(n - 1, h[1:], w)

    def score(self, text):
        w = ["<s>", "<s>", *tokens(text)]
        return sum(math.log10(self.p(2, (w[i - 2], w[i - 1]), w[i])) for i in range(2, len(w)))


def check(rows, got):
    model = BruteForce([t for d, t in rows if not held(d)])
    count = {g[0]: k for g, k in model.counts[0].items()}
    n, v = model.tokens, len(count)
    want = []
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(d), held(d), len(w), sum(x in count for x in w), n, base, model.score(t)))
    have = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    key = lambda r: (*r[:4], round(r[5], 3))
    for x, y in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=1e-6)
        assert x[6] == pytest.approx(y[6], abs=1e-6 + 1e-6 * x[2])
    return model


@pytest.mark.parametrize("limits", [{}, {"slice_tokens": 500, "bucket_rows": 700, "hot": 40}])
def test_equal_to_brute_force(spark, sf, limits):
    docs = c.documents(spark, sf)
    got = katz_scores(docs, **limits).collect()
    model = check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    # Every history's probabilities sum to 1 over all words and the unseen one.
    words = [g[0] for g in model.counts[0]] + ["never seen"]
    for h in [("<s>", "<s>"), *random.Random(3).sample(sorted(model.after[2]), 12), ("never seen", words[0]), (words[5], "never seen")]:
        assert abs(sum(model.p(2, h, w) for w in words) - 1) < 1e-9


def test_hot_histories_rare_and_common(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("aaaaabcde") for _ in range(rng.randint(0, 30)))) for k in range(300)]
    rows += [(1000 + k, "x y z " * 40) for k in range(50)] + [(2000 + k, rng.choice(["a x y", "q a b", "a q", "y z q"])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, katz_scores(docs).collect())
    check(rows, katz_scores(docs, slice_tokens=300, bucket_rows=100, hot=5).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    got = katz_scores(odd_docs).collect()
    check([(r.doc_id, r.text) for r in odd_docs.collect()], got)
    assert katz_scores(no_docs).collect() == []
    only = next(k for k in range(100) if held(k))
    alone = katz_scores(spark.createDataFrame([(only, "no training at all")], "doc_id long, text string")).collect()
    assert alone[0].train_tokens == 0 and alone[0].n_known == 0 and alone[0].base_score == 0 and np.isfinite(alone[0].score)


def test_keys_tell_patterned_words_apart():
    pattern = [0]
    while len(pattern) < 1024:
        pattern += [1 - x for x in pattern]
    words = ["".join("ab"[x] for x in pattern), "".join("ba"[x] for x in pattern), *(p * k for p in ("a", "\0", "ab") for k in range(1, 200, 7))]
    raw = [w.encode() for w in dict.fromkeys(words)]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    keys = c.word_keys(data, ends - [len(w) for w in raw], ends, 5)
    assert len(set(keys.tolist())) == len(raw)


def test_rows_of_wide_numbers():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500), rng.integers(0, 4, 500) << 50, rng.integers(0, 3, 500) << 40]
    first, place = katz.distinct_rows(columns)
    want = sorted(set(zip(*(x.tolist() for x in columns))))
    assert list(zip(*(x[first].tolist() for x in columns))) == want
    assert all(want[p] == row for p, row in zip(place.tolist(), zip(*(x.tolist() for x in columns))))


def test_discounts():
    assert all(0 < x <= 1 for x in katz.good_turing({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6})[1:])
    assert katz.good_turing({1: 3})[1] == 0.5


def test_what_is_read_no_more_is_deleted(spark, sf, tmp_path, monkeypatch):
    """When the texts have their numbers, neither keys nor slices are left on the disk."""
    seen, written = {}, c.written

    def watched(df, path=None, partition_by=None):
        out = written(df, path, partition_by)
        seen[path.split("/")[-1]] = {p.parent.name for p in tmp_path.rglob("part-*") if p.suffix == ".parquet"}
        return out

    monkeypatch.setattr(c, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(c, "written", watched)
    assert katz_scores(c.documents(spark, sf)).count() == c.documents(spark, sf).count()
    assert "kind=words" in seen["ids"] and seen["texts"] == {"kind=texts", "ids", "texts"}
    assert seen["order=3"] == {"texts", "order=3"} and seen["answers"] == {"texts", "order=3", "answers"}
