import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import documents, words

from quoteflow.llm import quality
from quoteflow.llm.quality import LABELLERS, Texts, keep_good, learn, posteriors, scored

SF = "/root/testdata/sf0.1"


def measured(text):
    raw = text.encode()
    w, plain = words(text), text.split()
    n = max(1, len(w))
    letters = sum(c.isascii() and c.isalpha() for c in text) or 1
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    punct = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}|~")
    return {
        "paired": sum(any(a == b and a in punct for a, b in zip(x, x[1:], strict=False)) for x in plain) / n,
        "bars": sum(x == "|" for x in plain) / n,
        "upper": sum(c.isascii() and c.isupper() for c in text) / letters,
        "commonest": max(Counter(w).values(), default=1) / n,
        "fresh": len(set(three)) / len(three) if three else 1.0,
        "distinct": max(1, len(set(w))) / n,
        "stopped": sum(x[-1] in ".," for x in plain) / n,
    } if raw else None


def test_measures_and_votes(spark):
    texts = ["One two, three. Four", "a%%% b### | |", "LOUD!! LOUD!! LOUD!!", "x " * 40, "été !! ça, | là.", "q"]
    found = Texts(pa.array(texts))
    codes = found.patterns()
    for i, t in enumerate(texts):
        want = measured(t)
        for name in want:
            assert found.measures[name][i] == pytest.approx(want[name]), (t, name)
        votes = []
        for name, side, junk, good, least in LABELLERS:
            x, sign = want[name], 1 if side == ">" else -1
            voted = 2 if sign * x >= sign * junk else 1 if sign * x <= sign * good else 0
            votes.append(voted if len(words(t)) >= least else 0)
        assert int(codes[i]) == int("".join(map(str, votes)), 3)


def test_expectation_maximisation_finds_the_labellers_rates():
    rng = np.random.default_rng(1)
    m, n = len(LABELLERS), 40000
    y = rng.random(n) < 0.1
    hit, false = rng.uniform(0.4, 0.9, m), rng.uniform(0.001, 0.03, m)
    votes = np.where(rng.random((n, m)) < np.where(y[:, None], hit, false), 2, 1)
    votes[rng.random((n, m)) < 0.2] = 0
    codes = votes @ 3 ** np.arange(m - 1, -1, -1)
    patterns, counts = np.unique(codes, return_counts=True)
    p = dict(zip(patterns, posteriors(patterns, counts.astype(float)), strict=True))
    called = np.array([p[c] >= 0.5 for c in codes])
    assert (called == y).mean() > 0.98


def test_awkward_rows(spark):
    prose = "The quiet river ran on, past old stones and low trees. Nobody came there in winter, so it kept its own time."
    rows = [(i, f"{prose} Number {i} adds some words, as texts do, to be its own.") for i in range(30)]
    rows += [(100 + i, "spam " * (30 + i)) for i in range(10)] + [(200 + i, f"a{i}%%% b### c$$$ d&&& e*** " * 8) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "Short."), (0, rows[0][1]), (None, prose), (None, None)]
    docs = documents(spark, rows)
    got = {}
    for r in scored(docs).collect():
        assert 0 <= r.score <= 1 and r.keep == (r.score < 0.5)
        got.setdefault(r.doc_id, []).append(r.keep)
    assert all(got[i] == [True] for i in [*range(1, 30), 303]) and got[0] == [True, True]
    assert not any(x for i in [*range(100, 110), *range(200, 210), 300, 301, 302] for x in got[i])
    assert sorted(got[None]) == [False, True]
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, x in got.items() for k in x if k)


def test_no_rows(spark):
    assert scored(documents(spark, [])).collect() == []
    assert keep_good(documents(spark, [(1, None)])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_labels_it_never_saw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = scored(docs, learn(docs)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    junk = [r.keep for r in rows if r.quality == 0]
    good = [r.keep for r in rows if r.quality == 1]
    assert np.mean(junk) < 0.06 and np.mean(good) > 0.995
    assert quality.SAMPLE >= 1000


def test_a_corpus_of_mostly_junk_gets_a_share_above_a_half():
    m = len(quality.LABELLERS)
    all_junk, all_good = sum(2 * 3**i for i in range(m)), sum(3**i for i in range(m))
    p = quality.posteriors(np.array([all_junk, all_good, 0]), np.array([900.0, 100.0, 50.0]))
    assert p[0] > 0.99 and p[1] < 0.01
    assert p[2] > 0.6  # nobody voted: the share of junk speaks
