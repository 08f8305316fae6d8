import random
from pathlib import Path

import numpy as np
import pytest
from brute import documents

from quoteflow.llm import packing
from quoteflow.llm.packing import END, best_fit, packed, position_ids, read_matrices, write_matrices, write_packed
from quoteflow.llm.pieces import model_path


def test_best_fit_decreasing_against_a_linear_search():
    rng = random.Random(6)
    for _ in range(200):
        length = rng.randint(1, 60)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 80))]
        rows, want = best_fit(sizes, length), []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            open_ = [(length - sum(sizes[j] for j in r), k) for k, r in enumerate(want)]
            open_ = [x for x in open_ if x[0] >= sizes[i]]
            if open_:
                want[min(open_)[1]].append(i)
            else:
                want.append([i])
        filled = lambda r: sorted(sum(sizes[j] for j in x) for x in r)
        assert filled(rows) == filled(want) and sorted(i for r in rows for i in r) == list(range(len(sizes)))


@pytest.mark.parametrize("shard", [100, 1 << 20])
def test_round_trip(spark, shard):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model_path())
    texts = [None, "", "one", "one", "a b c " * 90, "日本", "x" * 500, " "]
    texts += ["word " * random.Random(i).randint(1, 60) for i in range(40)]
    rows = [*enumerate(texts), (None, "of no id")]
    made = packed(documents(spark, rows), length=64, shard=shard)
    back, ends = {}, 0
    for r in position_ids(made).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and not ids[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens
        assert r.resets == r.cu_seqlens[:-1] and [r.position_ids[i] for i in r.resets] == [0] * len(r.resets)
        assert len(r.position_ids) == r.n_tokens and max(np.diff(r.position_ids)) <= 1
        for a, b, doc, begin in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.doc_ids, r.doc_begins, strict=True):
            back.setdefault(doc, []).append((begin, ids[a:b].tolist()))
    for doc, text in rows:
        ids = sp.encode(text or "")
        got = [i for _, part in sorted(back.get(doc, [])) for i in part]
        assert got == (ids + [END] if ids else []), doc
        ends += bool(ids)
    assert made.select("pack_id").distinct().count() == made.count()


def test_written_rows_and_no_rows(spark, tmp_path):
    docs = documents(spark, [(1, "some words here")])
    path = str(tmp_path / "packed")
    assert write_packed(docs, path, length=16).first() == packed(docs, length=16).first()
    assert write_packed(docs).count() == 1
    assert packed(documents(spark, [])).collect() == []


@pytest.mark.parametrize("at_once", [3, 1024])
def test_matrices_read_back_as_packed(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(packing, "_AT_ONCE", at_once)
    rows = [(i, "word " * random.Random(i).randint(0, 90)) for i in range(60)] + [(None, "of no id"), (7, None), (8, "")]
    docs = documents(spark, rows)
    path = write_matrices(docs, str(tmp_path / "matrices"), length=32, shard=300)
    Path(path, "shards", "lost.ids").write_bytes(b"left by an attempt that was lost")
    parts = ["n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "doc_begins"]
    got, want = read_matrices(spark, path), packed(docs, length=32, shard=300)
    assert sorted(map(repr, got.select(parts).collect())) == sorted(map(repr, want.select(parts).collect()))
    assert got.select("pack_id").distinct().count() == got.count()
    for shard in spark.read.parquet(f"{path}/manifest").collect():
        load = lambda part, kind: np.memmap(f"{path}/shards/{shard.shard}.{part}", kind, "r")  # noqa: E731, B023
        ids, cu, at = load("ids", "<u2").reshape(shard.rows, shard.length), load("cu", "<i4"), load("at", "<i8")
        assert shard.width == 2 and len(at) == shard.rows + 1 and len(load("resets", "<i4")) == shard.segments
        last = cu[at[1:] - 1]
        assert last.sum() == shard.n_tokens and all(not row[n:].any() for row, n in zip(ids, last, strict=True))
    with pytest.raises(Exception, match="(?i)exists"):
        write_matrices(docs, path, length=32)


def test_matrices_of_no_rows(spark, tmp_path):
    path = write_matrices(documents(spark, [(1, None), (2, "")]), str(tmp_path / "none"))
    assert read_matrices(spark, path).collect() == []
