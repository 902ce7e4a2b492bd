import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from gavel.llm import language_id as lid
from gavel.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return lid.fit_dictionaries(docs.where(~lid.held_out()))


def test_accuracy_on_held_out_documents(spark):
    found = queries.op4_language_id(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in held) / len(held) < 0.03


def test_only_training_rows_matter(spark, learned):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    changed = docs.withColumn("lang", F.when(lid.held_out(), "xx").otherwise(F.col("lang")))
    assert lid.fit_dictionaries(changed.where(~lid.held_out())) == learned
    assert all(0 < len(x) <= lid.DICTIONARY_BYTES for x in learned.values())


def test_defined_cases(spark, learned):
    texts = [None, "", " \n", "123 -- !?", "²³", "the and of that thing there", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, "clash", "b") for i, t in enumerate(texts)] + [(5, texts[5], "", "")],
                                 "doc_id long, text string, score string, batch string")
    out = lid.identify_language(docs, learned)
    assert out.columns == ["doc_id", "text", "batch", "lang_pred", "score", "rejected"]
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in rows[:5]] == [("und", 0.0, True)] * 5
    assert rows[5]["lang_pred"] == "en" and rows[5][1:2] == rows[6][1:2]
    assert rows[-1]["lang_pred"] in learned
    assert lid.identify_language(docs.where("false"), learned).collect() == []


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab cd", "q"), (2, None, "q"), (3, "zz", None), (None, "yy", "r")],
                                 "doc_id long, text string, lang string")
    learned = lid.fit_dictionaries(docs)
    assert list(learned) == ["q"]
    rows = lid.identify_language(docs, learned).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("q", 1.0), ("q", 1.0), ("und", 0.0), ("q", 1.0)]
    assert lid.fit_dictionaries(docs.where("false")) == {}
    assert {r["lang_pred"] for r in lid.identify_language(docs, {}).collect()} == {"und"}


def test_mixed_and_short_texts_are_rejected(spark, learned):
    classifier = lid.Classifier(learned)
    assert classifier.predict("q")[1] < lid.MIN_MARGIN


def plain_language(text, learned):
    """Best language and margin of one text, with a new compressor for every block."""
    runs, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""
    data = " ".join(runs).encode()
    if not data:
        return "und", 0.0
    sizes = {}
    for lang, content in learned.items():
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[lang] = 0
        for i in range(0, len(data), 1024):
            one = zstandard.ZstdCompressor(level=6, dict_data=given, write_content_size=False,
                                           write_checksum=False, write_dict_id=False)
            sizes[lang] += len(one.compress(data[i:i + 1024]))
    best, second = sorted(sizes, key=lambda lang: (sizes[lang], lang))[:2]
    return best, 1 - sizes[best] / sizes[second]


def test_agrees_with_a_plain_loop(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lid.identify_language(docs, learned).collect()
    assert len(rows) > 90
    for r in rows:
        lang, margin = plain_language(r["text"], learned)
        assert (r["lang_pred"], r["rejected"]) == (lang, lang == "und" or margin < 0.01)
        assert r["score"] == pytest.approx(margin, abs=1e-12)
