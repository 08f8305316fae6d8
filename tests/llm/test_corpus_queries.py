"""The registered queries on the smallest tables, against SQL or a plain version."""

import hashlib
import os

import pytest
from brute import classes, jaccard_links, shingles, words

import corpus_pipeline
from quoteflow.llm import pii, quality
from quoteflow.llm.catalog import ORACLE, QUERIES
from quoteflow.llm.common import table
from quoteflow.llm.pieces import model_path

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) < set(QUERIES)
    assert "pipeline" in __spark_entry__.queries() and set(QUERIES) < set(__spark_entry__.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    df, answer = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(answer.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    place = [answer.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in place)) for r in answer.fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op7_token_packing"}))
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())


def test_pipeline_against_plain_steps(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model_path())
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in quality.scored(docs).collect() if r.keep}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    first = classes(sets, jaccard_links(sets, 4, 5))
    texts = {i: t for i, t in texts.items() if first[i] == i}
    for item in table(spark, SF, "benchmark").collect():
        want = shingles(item.text, 5)
        for i in list(texts):
            w = words(texts[i])
            if want and 5 * len(want & {tuple(w[k : k + 5]) for k in range(len(w))}) >= 4 * len(want):
                del texts[i]
    kept = docs.filter(docs.doc_id.isin(list(texts)))
    field = pii.learn(kept)
    want = {}
    for i, t in texts.items():
        ids = sp.encode(pii.hidden(t, pii.all_spans(field, t)))
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[i] = (len(ids), sha, hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(got) < len(first)
