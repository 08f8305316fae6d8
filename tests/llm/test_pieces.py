import hashlib
import random

import pytest
from brute import documents

from quoteflow.llm import pieces
from quoteflow.llm.pieces import Vocabulary, digests, encode, model_path, piece_ids, piece_texts, vocabulary

ODD = [None, "", " ", "  a  b ", "▁x ▁▁ y", "\n\t a", "日本語 テキスト 😀 ok", "a" * 3000, " " * 900, "\x00\x01", "1234567", "ab" * 700, "<s> </s> <unk> <0x41>", "é ñ　x", "the The THE", "الله 𝒳"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def mixed(seed, n):
    rng = random.Random(seed)
    stock = ["a", "b", "on", "the", " ", "  ", "▁", "\n", ".", "é", "漢", "😀", "ction", "7", "he", "\t", "%%%"]
    return ["".join(rng.choices(stock, k=rng.randint(0, 600))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_ids_and_texts_are_the_librarys(library, monkeypatch, small):
    if small:  # long texts in parts, small slices, a small store of known segments, the heap for most segments
        monkeypatch.setattr(pieces, "PART", 200)
        monkeypatch.setattr(pieces, "SLICE", 700)
        monkeypatch.setattr(pieces, "LONG", 3)
        monkeypatch.setattr(pieces, "PART", 300)
    v = Vocabulary(model_path())
    v.known.most = 500 if small else v.known.most
    texts = ODD + mixed(4, 120)
    ids, at = encode(v, texts)
    want = library.encode([t or "" for t in texts], num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert pieces.decode(v, ids, at) == library.decode(want)


def test_decoding_any_ids_is_the_librarys(library):
    import numpy as np

    rng = random.Random(9)
    lists = [[rng.choice([0, 1, 2, *range(3, 259), *rng.choices(range(259, 32000), k=200)]) for _ in range(30)] for _ in range(150)]
    at = np.cumsum([0, *map(len, lists)])
    assert pieces.decode(vocabulary(model_path()), np.array(sum(lists, []), np.int64), at) == library.decode(lists)


def test_rows(spark, library):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "x")]
    docs = documents(spark, rows)
    got = sorted(map(tuple, digests(piece_ids(docs, decoded=True)).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    back = sorted(map(tuple, piece_texts(piece_ids(docs)).collect()), key=str)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=str)
    assert digests(piece_ids(documents(spark, []), decoded=True)).collect() == []
