import random
import re
from collections import defaultdict

from shoebox.llm import common as c
from shoebox.llm.decontaminate import NUMBER_WORDS, UNITS, decontaminate, without_leaks

ITEMS = [
    (1, "A train leaves Boston at 9 hours and travels 120 miles to reach its final stop near Albany before 12 hours pass."),
    (2, "Four short words here"),
    (3, None),
    (None, "no id has this one at all here today"),
    (4, "12 12"),
]


def leaks(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate(docs, bench, **options).collect()}


def test_slots(spark):
    base = ITEMS[0][1]
    got = leaks(
        spark,
        [
            f"Before it. {base} After it.",
            base.upper(),
            base.replace("120", "3,450.5").replace("miles", "km").replace("12 hours", "7 days").replace("9 hours", "4 days"),
            base.replace("Boston", "Denver").replace("Albany", "Aspen"),
            base.replace("12 hours", "9 days"),  # a stray value near the end: the windows before it are verbatim
            " ".join(base.split()[:6]),
            "nothing of the kind " * 10,
            None,
            "",
            "well, FOUR  short, words here.",
            "12 12 12",
        ],
    )
    assert sorted(got) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 2)]
    assert got[4, 1].exact and 0.5 <= got[4, 1].coverage < 1
    assert got[0, 1].exact and got[0, 1].coverage == 1.0 and got[0, 1].n_changed == 0
    assert not got[2, 1].exact and got[2, 1].n_changed >= 4
    assert not got[3, 1].exact


def test_every_planted_item_and_nothing_else(spark, sf):
    """Against brute force: an item leaks if a document has half of its 8-word windows."""

    def tokens(text):
        return "".join(ch.lower() if ch.isalnum() else " " for ch in text).split()

    docs, bench = c.documents(spark, sf), c.benchmark(spark, sf)
    want = set()
    for d in docs.collect():
        t = tokens(d.text)
        have = {tuple(t[i : i + 8]) for i in range(len(t) - 7)}
        for b in bench.collect():
            w = tokens(b.text)
            win = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
            if win and sum(x in have for x in win) >= len(win) / 2:
                want.add((d.doc_id, b.item_id))
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()}
    assert got == want and want


def test_any_sieve_gives_the_same(spark, sf):
    docs, bench = c.documents(spark, sf), c.benchmark(spark, sf)
    one, many = ({tuple(r) for r in decontaminate(docs, bench, sieve_most=n).collect()} for n in (27, 10))
    assert one == many


def brute(text, item, coverage=0.5):
    """For lower-case texts: template windows of eight, slots by vote, over each diagonal and over all of them."""

    def parts(t):
        out = []
        for w in re.findall(r"[a-z0-9]+", t):
            kind = "#" if w[0].isdigit() or w in NUMBER_WORDS else "%" if w in UNITS else w
            if kind == "#" and out and out[-1][0] == "#":
                out[-1] = ("#", out[-1][1] + " " + w)
            else:
                out.append((kind, w))
        return [tuple(out[i : i + 8]) for i in range(len(out) - 7) if sum(k in "#%" for k, _ in out[i : i + 8]) <= 4]

    def template(w):
        return tuple(k for k, _ in w)

    mine, theirs = ([(i, w) for i, w in enumerate(parts(t))] for t in (item, text))
    met = [(i, j, a, b) for i, a in mine for j, b in theirs if template(a) == template(b)]
    best = 0
    for windows in [met, *([m for m in met if m[1] - m[0] == d] for d in {j - i for i, j, _, _ in met})]:
        bearers = defaultdict(set)
        for i, _, a, b in windows:
            for (kind, x), (_, y) in zip(a, b):
                if kind in "#%":
                    bearers[x, y].add(i)
        there, back = {}, {}
        for x, y in sorted(bearers, key=lambda p: (-len(bearers[p]), p[0] != p[1], p)):
            if x not in there and y not in back:
                there[x], back[y] = y, x
        best = max(best, len({template(a) for _, _, a, b in windows if all(there.get(x) == y for (k, x), (_, y) in zip(a, b) if k in "#%")}))
    return best / len({template(w) for _, w in mine}) >= coverage


def test_reparameterised_items_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"{x}{y}a" for x in "bcdfg" for y in "aeiou"]

    def text(n):
        return [rng.choice(words) if rng.random() < 0.75 else rng.choice(["3", "4", "5", "km", "hours", "seven"]) for _ in range(n)]

    items = [(k, " ".join(text(rng.randint(12, 30)))) for k in range(12)]
    docs = []
    for _ in range(150):
        tokens = rng.choice(items)[1].split()
        swap = dict(zip(["3", "4", "5", "km", "hours", "seven"], rng.sample(["3", "4", "5", "8", "9"], 3) + rng.sample(["km", "miles"], 2) + [rng.choice(["3", "7", "seven"])]))
        for _ in range(rng.randint(0, 3)):  # renamed parameters, insertions, cuts, strays and repeats
            how, at = rng.randrange(5), rng.randrange(len(tokens))
            tokens = [
                [swap.get(t, t) for t in tokens],
                tokens[:at] + text(3) + tokens[at:],
                tokens[: at + 9],
                tokens[:at] + [rng.choice("3456")] + tokens[at + 1 :],
                tokens + tokens[at : at + 9],
            ][how]
        docs.append(" ".join(text(4) + tokens + text(4)))
    want = {(d, k) for d, t in enumerate(docs) for k, item in items if brute(t, item)}
    assert set(leaks(spark, docs, items)) == want and 30 < len(want) < 150


def test_repeated_phrases_and_stray_numbers(spark):
    phrase = "how many red apples are left over then"
    item = (1, f"{phrase} {phrase} after we sold some")
    many = (2, "a shop sells 12 pens and 30 books a day until 12 pens are left for the last 5 buyers who want them all")
    stray = many[1].replace("last 5 buyers", "last 12 buyers")
    got = leaks(spark, [" ".join(f"{phrase} no{k}" for k in range(8)), stray, many[1].replace("12", "13")], [item, many])
    assert sorted(got) == [(1, 2), (2, 2)]


def test_without_leaks_and_clashing_names(spark, odd_docs):
    bench = odd_docs.where("doc_id = 1").selectExpr("77L AS item_id", "text")
    docs = odd_docs.withColumnsRenamed({"row": "text_key_0", "start": "leaks", "lang": "__text"})
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text is None or r.doc_id not in gone)


def test_odd_rows(spark, sf, odd_docs, no_docs):
    bench = c.benchmark(spark, sf)
    assert decontaminate(no_docs, bench).collect() == [] and decontaminate(odd_docs, bench.where("false")).collect() == []
    own = odd_docs.where("doc_id = 1").selectExpr("77L AS item_id", "text")
    assert sorted(r.doc_id or 0 for r in decontaminate(odd_docs, own).collect()) == [0, 1, 2, 3]


def test_names_that_open_sentences(spark):
    item = (1, "Betty has 10 apples. Tom has 20 apples. Anna has twice as many as Tom. How many apples do they have?")
    accents = (2, "Élodie buys 3 red pears. Then Élodie and Łukasz eat 2 of the pears. Łukasz likes them. What is left of all pears?")
    swapped = item[1].replace("Betty", "Carl").replace("Tom", "Susan").replace("Anna", "Peter")
    texts = [
        swapped,
        swapped.replace("as many as Susan", "as many as Carl"),  # Tom stands for two now: windows with the other one don't count
        "First:\n" + accents[1].replace("Élodie", "Zoé").replace("Łukasz", "Дмитрий"),
        "Betty was here. Tom was not. How many of them do you know?",
    ]
    got = leaks(spark, texts, [item, accents])
    assert sorted(got) == [(0, 1), (1, 1), (2, 2)] and got[1, 1].coverage < 0.7
    assert got[0, 1].coverage == 1.0 and not got[0, 1].exact and got[0, 1].n_changed == 4


def test_verbatim_items_of_few_words(spark):
    items = [(1, "Convert 5 km 300 m to cm"), (2, "Compute 12 + 7 - 3"), (3, "Add 3 km 20 m, 4 km 50 m, 7 km 90 m and 2 km 15 m")]
    texts = [f"Before it. {t} After it." for _, t in items]
    texts += [texts[0].replace("300", "400"), texts[1].replace("7", "8"), "Convert 5 km to m, or 300 m to cm", "12 7 3"]
    got = leaks(spark, texts, items)
    assert sorted(got) == [(0, 1), (1, 2), (2, 3)]
    assert all(r.exact and r.coverage == 1.0 and r.n_changed == 0 for r in got.values())
