"""The prefix-filter join against comparing all pairs."""

import random

import numpy as np

from tracemill.llm import overlap as O

SCHEMA = "case_id long, split string, source_dataset string, source_id string, question string, words int"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_join_finds_exactly_the_pairs(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 30))] for _ in range(40)]
    rows = []
    for i in range(240):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            k = r.randrange(len(w))
            r.choice([lambda: w.__setitem__(k, r.choice(vocab)), lambda: w.insert(k, r.choice(vocab)), lambda: len(w) > 1 and w.pop(k)])()
        rows.append((i, r.choice(["train", "validation", "test"]), None, None, " ".join(w), 0))
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" != b[1]:
                x, y = a[4].split(), b[4].split()
                if lcs(x, y) >= O._ceil(O.AGREE * max(len(x), len(y))):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    for few in (0, 2, 1_000):  # shingles of five words, of some, of one
        assert {tuple(p) for p in O.pair_rows(O.overlaps(df, few=few, hot=3)).collect()} == want
    counted = {r["case_id"]: r["links"] for r in O.link_counts(O.links(df)).collect()}
    evals = {x[0] for x in rows if x[1] != "train"}
    assert counted == {i: sum(i in p for p in want) for i in evals}
    assert len(want) > 50


def test_hot_shingles_are_salted_not_dropped(spark):
    rows = [(i, "train" if i % 2 else "test", None, None, "a b c d e f g h i " + str(i % 3), 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(p) for p in O.pair_rows(O.overlaps(df, hot=3)).collect()}
    assert len(want) == 900  # nine of ten words agree everywhere


def test_defined_cases(spark):
    rows = [
        (1, "train", "PathVQA", "pathvqa_000012", None, 0),
        (2, "test", "path_vqa", "PATHVQA-12", "", 0),
        (3, "test", "datasets/pathvqa", "12", "?!", 0),
        (4, "train", None, "12", "some words here", 0),
        (5, "validation", "SLAKE", None, "Some words, here!", 0),
        (5, "validation", "SLAKE", None, "Some words, here!", 0),
        (6, None, "PathVQA", "12", "some words here", 0),
        (7, "train", "PathVQA", "13", "x " * 5000, 0),
        (None, "test", "PathVQA", "12", "some words here", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = O.overlaps(df)
    assert {tuple(p) for p in O.pair_rows(found).collect()} == {(1, 2), (1, 3), (4, 5)}
    rep = {(r["split"], r["source"]): (r["cases"], r["overlapping"], r["pairs"]) for r in O.overlap_report(O.link_counts(O.links(df))).collect()}
    assert rep == {("test", "pathvqa"): (2, 2, 2), ("validation", "slake"): (1, 1, 1)}
    got = {r["case_id"]: (r["split"], r["source"], r["class_id"] is None, r["links"]) for r in O.link_counts(O.links(df)).collect()}
    assert got == {2: ("test", "pathvqa", True, 1), 3: ("test", "pathvqa", True, 1), 5: ("validation", "slake", False, 1)}
    assert O.overlaps(df.where("false")).count() == O.link_counts(O.links(df.where("false"))).count() == 0


def test_shingles_of_short_and_repeated_words():
    freq = np.full(O.CELLS, 9, np.int32)
    for n in (1, 2, 8, 9, 40, 400, 5_000):
        for words in (np.arange(n), np.zeros(n, np.int64)):
            out = O.shingles(words, freq, 10, O.AGREE)
            assert (len(out) > 0) == (n >= max(O.widths(n, O.AGREE))) and len({k for k, *_ in out}) == len(out) <= O.SHINGLES * 3
    assert O.widths(9, 0.88) == {5} and O.widths(5, 0.8) == {4} and O.widths(4_000, 0.88) == {1} and max(O.widths(6, 0.5)) == 1
