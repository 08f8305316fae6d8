import random
import re

import pytest
from brute import documents
from pyspark.sql import functions as F

from quoteflow.llm import token_counts as token_counts_module
from quoteflow.llm.pieces import model_path
from quoteflow.llm.token_counts import MODEL, PLAIN, RANKS, encoder, token_counts


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(model_path(MODEL))


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys_however_texts_are_cut(spark, library):
    rng = random.Random(3)
    stock = ["the ", "and", "\n", "  ", "é", "1", "<|endoftext|>", "漢", "word", "'s", " \n", "\u00a0"]
    texts = ["", None, "  ", "a <|endoftext|> b", "日本 語 x" * 50, "x" * 3000, "a b" * 900, " \n " * 700, "<|endoftext|>" * 300]
    texts += ["".join(rng.choices(stock, k=rng.randint(1, 2500))) for _ in range(50)]
    rows = [*enumerate(texts), (6, texts[6]), (None, "x y")]
    got = sorted(map(tuple, token_counts(documents(spark, rows), chunk=256, overlap=32).collect()), key=str)
    want = [(i, len((t or "").encode()), count(library, t), count(library, t) > 1024) for i, t in rows]
    assert got == sorted(want, key=str)


def test_plain_characters_mean_the_same_to_both_libraries(library):
    known = encoder(MODEL, RANKS)
    chars = [chr(c) for c in range(0x2200) if re.fullmatch(f"[{PLAIN}]", chr(c))]
    assert len(chars) > 500
    for c in chars:
        text = f"a{c}b {c}{c} 1{c}2 {c}a  {c}"
        assert known.plain.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids, repr(c)


def test_no_rows(spark):
    assert token_counts(documents(spark, [])).collect() == []


@pytest.mark.parametrize("stock", ["слово ", "Ελληνικά και ", "汉字，没有空格。", "ภาษาไทยไม่มีช่องว่าง", "हिन्दी पाठ ", "日本語の文、です"])
def test_texts_of_any_script_are_spliced_at_once(spark, library, stock):
    text = stock * (300_000 // len(stock.encode()))
    docs = documents(spark, [(1, text)])
    rows = docs.select("text").withColumn("row", F.lit(1).cast("long"))
    parts = token_counts_module._parts(rows, 8192, 1024)
    encoded = parts.mapInArrow(token_counts_module._encoded(MODEL, RANKS, 8192, 1024), token_counts_module._ENCODED)
    assert parts.count() > 30
    assert [r.tokens for r in token_counts_module._spliced(encoded).collect()] == [count(library, text)]


def test_edges_are_boundaries_of_any_reading(library):
    rng = random.Random(5)
    stock = ["a", "é", "字", "1", "٣", " ", "\n", "'s", "'", "。", "ก", "ั", "-", " ", "😀", "Ж"]
    for _ in range(200):
        text = "".join(rng.choices(stock, k=30))
        raw = text.encode()
        for at in token_counts_module._edges(text).tolist():
            a, b = raw[:at].decode(), raw[at:].decode()
            assert count(library, a) + count(library, b) == count(library, text), (a, b)
