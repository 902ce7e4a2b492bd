"""The pipeline against a plain version of its stages."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gavel.llm import language_id, mixing
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_simhash_dedup import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[1:-1])


def test_language_stage(spark, stages):
    docs = stages[0]
    classifier = language_id.Classifier(language_id.fit_dictionaries(docs.where(~language_id.held_out())))
    kept = sorted(r["doc_id"] for r in docs.collect()
                  if classifier.predict(r["text"])[1] >= language_id.MIN_MARGIN)
    assert kept == sorted(r["doc_id"] for r in stages[1].collect())
    assert len(kept) > 0.95 * docs.count()


def test_line_stage(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    after = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert sorted(after, key=repr) == [x[:2] for x in plain_lines(before)]


def test_copies_stage(stages):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in stages[2].collect()}
    roots, least = plain_components(prints.values()), {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    assert sorted(least.values()) == sorted(r["doc_id"] for r in stages[3].collect())


def test_mixing_stage(stages):
    before, after = stages[3].collect(), Counter(r["doc_id"] for r in stages[4].collect())
    assert set(after) == {r["doc_id"] for r in before} and max(after.values()) <= 2
    totals, shown = Counter(), Counter()
    for r in before:
        totals[r["source"]] += len(r["text"].split())
        shown[r["source"]] += len(r["text"].split()) * after[r["doc_id"]]
    most = max(totals.values())
    for s in totals:
        assert shown[s] >= totals[s] and (totals[s] != most or shown[s] == most)
    ratio = most / min(totals.values())
    a = next(a for a in np.arange(0, 1, 2.0 ** -mixing.ROUNDS) if ratio ** (1 - a) <= mixing.MAX_REPEATS)
    for s, n in totals.items():
        budget = int(((most / n) ** (1 - a) - 1) * n)
        assert budget <= shown[s] - n <= budget + 20_000


def test_packing_stage(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in stages[4].collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            expected[r["doc_id"], k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    rows = stages[5].collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    ends = Counter()
    for r in rows:
        ends[r["sequence_id"]] = max(ends[r["sequence_id"]], r["offset"] + r["length"])
    assert sum(ends.values()) == sum(r["length"] for r in rows) and max(ends.values()) <= 4096


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[5].count()


def test_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.collect() == []


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (2, "", "en", "a", 0, 1),
         (None, "the and of that thing there is", None, None, None, 1),
         (3, "the and of that thing there is with", "en", "a", 35, 1)],
        "doc_id long, text string, lang string, source string, n_chars long, piece int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert {r["doc_id"] for r in docs.collect()} <= {None, 3}
