import numpy as np
import pytest
from brute import classes

from quoteflow.llm import embedding_dedup
from quoteflow.llm.embedding_dedup import near_duplicates


def vectors(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "vec_id long, label int, embedding array<float>, id long, cell int")


def brute(rows, least=0.98):
    good = []
    for i, label, e in rows:
        if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            good.append((i, label, np.array(e, np.float32).astype(float)))
    links = set()
    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[k + 1 :]:
            if a == b and len(x) == len(y) and (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links.add((i, j))
    ids = [r[0] for r in rows if r[0] is not None]
    up = classes(ids, links)
    return {i: (sum(i in x for x in links), up[i], up[i] == i) for i in ids}


@pytest.mark.parametrize("cell", [20, 2048])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", cell // 2)
    rng = np.random.default_rng(4)
    rows, centres = [], rng.normal(size=(12, 6))
    for i in range(260):
        x = centres[i % 12] + rng.normal(size=6) * rng.choice([0.02, 0.15, 0.6])
        rows.append((i * 7 + 3, int(rng.choice([0, 0, 0, -5])), [float(v) for v in x * rng.choice([0.1, 1, 30])]))
    rows += [(9000 + i, 0, rows[5][2]) for i in range(30)]
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(vectors(spark, rows)).collect()}
    assert got == brute(rows) and sum(x[0] for x in got.values()) > 500


def test_awkward_rows(spark):
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [5.0, 0.1]), (4, 0, [1.0, 0.0, 0.0]), (5, 1, [1.0, 0.0]), (6, None, [1.0, 0.0]),
        (7, 0, None), (8, 0, []), (9, 0, [0.0, 0.0]), (10, 0, [1.0, None]), (11, 0, [1.0, float("nan")]), (12, 0, [float("inf"), 0.0]),
        (13, 0, [1e30, 0.0]), (14, 0, [1e-30, 0.0]), (15, 0, [-1.0, 0.0]),
    ]
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(vectors(spark, rows)).collect()}
    assert got == brute(rows) and got[1] == (4, 1, True)
    more = near_duplicates(vectors(spark, [*rows, (2, 1, [0.0, 1.0]), (None, 0, [1.0, 0.0])])).collect()
    assert {r[0]: tuple(r)[1:] for r in more if r[0] is not None} == got
    assert [tuple(r) for r in more if r[0] is None] == [(None, 0, None, True)]


@pytest.mark.parametrize("kind", ["double", "decimal(8,3)", "int"])
def test_other_kinds_of_numbers(spark, kind):
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate([(3, 4), (6, 8), (0, -2), (-0.0, -1), (4, -3)])]
    frame = vectors(spark, rows).selectExpr("vec_id", "label", f"cast(embedding as array<{kind}>) as embedding")
    assert {r[0]: tuple(r)[1:] for r in near_duplicates(frame).collect()} == brute(rows)


def test_pivots_are_of_different_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 10)
    rng = np.random.default_rng(8)
    rows = [(i, 0, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(1000 + i, 0, [1.0, 2.0, 3.0, 4.0]) for i in range(400)]
    seen, whole = [], embedding_dedup._pivots
    monkeypatch.setattr(embedding_dedup, "_pivots", lambda *args: seen.append(whole(*args)) or seen[-1])
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(vectors(spark, rows)).collect()}
    (pivots,) = seen[0].values()
    assert 10 <= len(pivots) <= 21 and len(np.unique(pivots, axis=0)) == len(pivots)
    assert got[1000][0] >= 399 and got[1399][1] == got[1000][1]


def test_no_rows(spark):
    assert near_duplicates(vectors(spark, [])).collect() == []
    assert near_duplicates(vectors(spark, [(1, None, None)])).collect()[0][:3] == (1, 0, 1)
