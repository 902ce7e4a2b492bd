import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gavel.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", [
    "", " ", "Hello wörld  it's <|endoftext|>x a<|startoftext|>b", " a b\x1cc\x85d\x0be",
    " é ́x é", "İstanbul ΑΣ ΑΣ.", "don't 12ab'll", "x" * 500 + " y" * 3, "\r\n\ta\r\rb\t", "\x00a​b",
])
def test_ids_are_those_of_the_tokenizer(plain, text):
    words = packing.WordTokenizer(PATH)
    expected = plain.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == expected


def test_cache_is_bounded(monkeypatch, plain):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    words = packing.WordTokenizer(PATH)
    for text in ("a b c d", "e f g", "a e i o u", "a b c d"):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain.encode(
            text, add_special_tokens=False).ids


def test_piece_is_merged_once(monkeypatch, plain):
    # Words that differ by case and marks share their piece, and don't crowd it out.
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    merged = Counter()

    def tokenize(piece):
        merged[piece] += 1
        return plain.model.tokenize(piece)

    counting = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), encode=plain.encode)
    monkeypatch.setattr("tokenizers.Tokenizer", SimpleNamespace(from_file=lambda path: counting))
    words = packing.WordTokenizer(PATH)
    pick = random.Random(5)
    stems = ["".join(pick.choice("abcé") for _ in range(7)) + "x" for _ in range(60)]
    texts = ["\n".join(form.format(w) for w in stems) for form in ("{}", "{}.", "({},", "{}'s\t7", "é '{}'\r")]
    for text in [*texts, *map(str.title, texts), *texts]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain.encode(
            text, add_special_tokens=False).ids
    assert len(merged) > 60 and set(merged.values()) == {1}


@pytest.mark.parametrize("seed", range(20))
def test_pieces_are_those_of_the_tokenizer(plain, seed):
    pick = random.Random(seed)
    words = packing.WordTokenizer(PATH)
    signs = [*"aZéÀßÿ7''.,&<|> \n\t\r", "'S", "'ll", "…", "ſ", "\x0c", "\xa0", "÷", "́"]
    for upto in (15, len(signs)):
        text = "".join(pick.choice(signs[:upto]) for _ in range(300))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain.encode(
            text, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """Least number of bins, by trying all placements."""
    best, lengths = len(lengths), sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[k] -= lengths[i]
            place(i + 1, rooms)
            rooms[k] += lengths[i]
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_few_sequences(seed):
    pick = random.Random(seed)
    lengths = [pick.randint(1, 30) for _ in range(pick.randint(1, 11))]
    fillings = packing.complete_bins(Counter(lengths), 30)
    used = sum((Counter({x: n * k for x, n in Counter(f).items()}) for f, k in fillings), Counter())
    assert used == Counter(lengths) and all(sum(f) <= 30 for f, _ in fillings)
    assert packing.least_sequences(Counter(lengths), 30) <= fewest(lengths, 30)
    assert sum(k for _, k in fillings) <= fewest(lengths, 30) + 1


def test_large_counts_make_few_fillings():
    pick = random.Random(1)
    counts = Counter(min(4096, max(1, int(pick.lognormvariate(6.5, 1)))) for _ in range(20_000))
    many = {x: n * 10 ** 6 for x, n in counts.items()}
    fillings = packing.complete_bins(many)
    assert sum(k for _, k in fillings) <= packing.least_sequences(many, 4096) * 1.001
    assert len(fillings) < 20_000


def test_fillings_of_many_short_pieces():
    # More pieces in a sequence than Python nests calls.
    for counts in ({1: 9000}, {1: 5000, 2: 4000, 3: 3000, 4095: 2, 4000: 1}, {3: 10 ** 6, 90: 7}):
        fillings = packing.complete_bins(counts)
        used = sum((Counter({x: n * k for x, n in Counter(f).items()}) for f, k in fillings), Counter())
        assert used == Counter(counts) and all(sum(f) <= 4096 for f, _ in fillings)
        assert sum(k for _, k in fillings) <= packing.least_sequences(counts, 4096) * 1.001


def check(rows, docs, plain, capacity):
    expected = []
    for d, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            expected.append((d, k // capacity, k, len(part),
                             zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_documents(spark, plain):
    pick = random.Random(2)
    docs = [(i, " ".join(pick.choice("ab cd efg".split()) for _ in range(pick.randint(0, 60))))
            for i in range(200)]
    docs += [(7, "a b"), (7, "a b"), (None, None), (None, "c"), (900, "")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, length int, rank int")
    packed = packing.pack_documents(frame.repartition(7), capacity=40, with_ids=True).cache()
    rows = packed.collect()
    n = check(rows, docs, plain, 40)
    assert n == packing.least_sequences(Counter(r["length"] for r in rows), 40)
    whole = packing.sequences(packed).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in rows)
    by_sequence = {r["sequence_id"]: r["ids"] for r in whole}
    for r in rows:
        assert by_sequence[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_many_short_documents(spark, plain):
    docs = [(i, ("", None, "a", "ab cd")[i % 4]) for i in range(6000)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert check(rows, docs, plain, 4096) == packing.least_sequences(Counter(r["length"] for r in rows), 4096)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(frame).collect() == []
