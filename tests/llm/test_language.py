import os

import pytest
from brute import documents
from pyspark.sql import functions as F

from quoteflow.llm import language
from quoteflow.llm.language import held_out, identify, learn

SF = "/root/testdata/sf0.1"
EN = "the river and the hill were there when we came with them over the bridge that they had made"
FR = "les rues de la ville étaient vides quand nous avons vu le soleil se lever sur les toits des maisons"


def taught(spark):
    rows = [("the and with that they them there when over bridge river hill made came had were", "en")] * 20
    rows += [("les de la des nous vu sur toits maisons soleil ville rues quand lever vides étaient avons", "fr")] * 20
    rows += [(None, "en"), ("text", None)]
    return learn(spark.createDataFrame(rows, "text string, lang string"))


def test_single_mixed_and_awkward_texts(spark):
    model = taught(spark)
    assert model.languages == ["en", "fr"]
    rows = [(1, EN), (2, FR), (3, f"{EN} {EN} {FR}"), (4, None), (5, ""), (6, "12 34 !?"), (7, "The"), (8, EN.upper()), (8, EN.upper())]
    rows += [(None, FR), (9, "é" * 20000), (10, (EN + " ") * 3000)]
    got = sorted(map(tuple, identify(documents(spark, rows), model).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert {i: by[i][1] for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, None)} == {
        1: "en", 2: "fr", 3: "en", 4: "und", 5: "und", 6: "und", 7: "en", 8: "en", 10: "en", None: "fr",
    }
    assert set(by[3][3]) == {"en", "fr"} and 0.55 < by[3][2] < 0.8 and sum(by[3][3].values()) == pytest.approx(1)
    assert set(by[1][3]) == {"en"} and by[4][2] == 0 and all(0 <= r[2] <= 1 for r in got)


def test_every_letter_counts():
    wanted = [chr(c).isalpha() for c in range(0x110000)]
    assert language._letters().tolist() == wanted
    assert [len(x) for x in language._trigrams(["\U00030000\U000323af"])[:2]] == [2, 1]


def test_nothing_to_learn_from_and_no_rows(spark):
    model = learn(spark.createDataFrame([], "text string, lang string"))
    assert identify(documents(spark, [(1, EN)]), model).first()[:3] == (1, "und", 0.0)
    assert identify(documents(spark, []), taught(spark)).collect() == []


def test_held_out_is_by_checksum(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(200).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    rows = identify(docs.filter(held_out(F.col("doc_id"))), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99
    assert language.PENALTY > 0
