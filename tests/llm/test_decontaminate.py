import random

from brute import documents, shingles, words

from quoteflow.llm import decontaminate
from quoteflow.llm.decontaminate import clean, contained_items


def items(spark, rows):
    return spark.createDataFrame([(i, t, None, None) for i, t in rows], "item_id long, text string, h long, doc_id long")


def brute(docs, tests, n=5, num=4, den=5):
    wanted, out = {}, set()
    for i, t in tests:
        if i is not None:
            wanted.setdefault(i, set()).update(shingles(t, n))
    for d in {i for i, _ in docs if i is not None}:
        have = set()
        for i, t in docs:
            if i == d:
                w = words(t)
                have |= {tuple(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)}
        for i, s in wanted.items():
            if s and den * len(s & have) >= num * len(s):
                out.add((d, i, len(s), len(s & have)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    tests = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 30, 70, 300])))) for i in range(25)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 4, 60, 900]))
        for _ in range(rng.choice([0, 1, 3])):
            part = rng.choice(tests)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = "changed"
            k = rng.randrange(len(w) + 1)
            w[k:k] = part
        docs.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    got = {tuple(r)[:4] for r in contained_items(documents(spark, docs), items(spark, tests)).collect()}
    assert got == brute(docs, tests) and len(got) > 20


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "one two"), (None, "one two three four five six"), (4, "one two three four five six"), (4, "seven"), (5, "x " * 4000)]
    tests = [(1, None), (2, "  "), (3, "one TWO"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one")]
    got = {tuple(r)[:4] for r in contained_items(documents(spark, docs), items(spark, tests)).collect()}
    assert got == brute(docs, tests) == {(3, 3, 1, 1), (4, 3, 1, 1), (4, 4, 2, 2)}
    kept = clean(documents(spark, docs), items(spark, tests))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 5, None]


def test_a_full_bitmap_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 16)
    docs, tests = [(1, "a b c d e f g"), (2, "q r s t u v")], [(1, "a b c d e f")]
    got = {tuple(r)[:4] for r in contained_items(documents(spark, docs), items(spark, tests)).collect()}
    assert got == {(1, 1, 2, 2)}


def test_no_rows(spark):
    assert contained_items(documents(spark, []), items(spark, [(1, "a b c d e")])).count() == 0
    assert contained_items(documents(spark, [(1, "a")]), items(spark, [])).count() == 0
    assert clean(documents(spark, [(1, "a")]), items(spark, [])).count() == 1
