import random

import numpy as np
import pytest
from brute import classes, documents, jaccard_links, shingles

from quoteflow.llm.ngram_join import NgramJoin, jaccard_classes, jaccard_links as found_links, keep_one


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split() or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w + rng.choices(vocabulary, k=rng.randint(1, 3))
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 25, 60]))
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_components_and_links_against_brute_force(spark, n, num, den):
    rows = corpus(n)
    sets = {i: shingles(t, n) for i, t in rows}
    links = jaccard_links(sets, num, den)
    want = classes(sets, links)
    got = {r[0]: (r[1], r[2]) for r in jaccard_classes(documents(spark, rows), n, num, den).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(frozenset(sets[i]), i)
    reps = {i for s, i in rep.items() if s}
    assert {tuple(r) for r in found_links(documents(spark, rows), n, num, den).collect()} == {
        (a, b) for a, b in links if a in reps and b in reps
    }


def test_a_hot_group_takes_star_rounds_and_keeps_every_document(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(rng.choices(range(80), k=150))]
    rows += [(1000 + i, " ".join(base)) for i in range(50)]
    sets = {i: shingles(t, 3) for i, t in rows}
    want = classes(sets, jaccard_links(sets, 9, 10))
    got = {r[0]: r[2] for r in jaccard_classes(documents(spark, rows), 3, 9, 10).collect()}
    assert got == want and len(set(want.values())) < 20


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B\n"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "z " * 5000)]
    rows += [(8, None), (None, "a b"), (None, None)]
    got = sorted(map(tuple, jaccard_classes(documents(spark, rows), 3, 9, 10).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 4, 6), (7, 1, 7), (8, 0, 8), (None, 1, None), (None, 0, None)],
        key=str,
    )


def test_an_id_with_several_texts_stands_for_its_least(spark):
    rows = [(1, "q r s t"), (2, "a b c d"), (2, "q r s t"), (3, "a b c d")]
    got = {r[0]: r[2] for r in jaccard_classes(documents(spark, rows), 3, 9, 10).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert sorted((r.doc_id, r.text) for r in keep_one(documents(spark, rows), 3, 9, 10).collect()) == [(1, "q r s t"), (2, "a b c d")]


def test_keep_one_keeps_columns_and_one_of_each_class(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, "other words are here now"), (10, None), (None, "a b c d e f")]
    docs = documents(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, "A b c d e f"), (9, "other words are here now"), (10, None), (None, "a b c d e f")], key=str
    )


def test_no_rows(spark):
    assert jaccard_classes(documents(spark, []), 3, 9, 10).collect() == []
    assert NgramJoin(documents(spark, [])).links().collect() == []
    assert keep_one(documents(spark, [])).count() == 0


def test_ids_in_steps_spread_over_all_groups():
    from quoteflow.llm.ngram_join import _group

    for step in (1, 10, 100, 1 << 20):
        sizes = np.bincount(_group(np.arange(-5000, 5000, dtype=np.int64) * step, 100), minlength=100)
        assert sizes.min() > 50 and sizes.max() < 200


def test_a_line_in_a_third_of_all_documents_and_ids_in_steps(spark):
    rng = random.Random(4)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(90)]
    texts = [f"{t} {line}" if i % 3 == 0 else t for i, t in enumerate(texts)] + [texts[5] + " q", texts[8]]
    rows = [(100 * i, t) for i, t in enumerate(texts)]
    sets = {i: shingles(t, 3) for i, t in rows}
    want = classes(sets, jaccard_links(sets, 9, 10))
    got = {r.doc_id: r.component_id for r in jaccard_classes(documents(spark, rows), 3, 9, 10).collect()}
    assert got == want
