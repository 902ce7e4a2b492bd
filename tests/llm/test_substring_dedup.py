import random

import numpy as np
import pytest

from gavel.llm import substring_dedup as sub

N = sub.LENGTH


def brute(docs):
    """Spans removed from each (id, text), by looking at every string of every document."""
    first = {}
    for d, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - N + 1):
            if d is not None:
                s = data[i:i + N]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, text in docs:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - N + 1):
            if d is not None and first[data[i:i + N]] < d:
                covered[i:i + N] = b"\1" * N
        spans, i = [], 0
        while i < len(data):
            j = i
            while j < len(data) and covered[j] == covered[i]:
                j += 1
            if covered[i]:
                spans.append((i, j))
            i = j
        kept = bytes(c for c, m in zip(data, covered) if not m)
        out.append((d, len(data), spans, kept))
    return sorted(out, key=repr)


def run(spark, docs):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs],
                                  "doc_id long, text string, place int, doc string").repartition(3)
    out = sub.remove_repeats(frame)
    assert out.columns == ["doc_id", "n_bytes", "spans", "kept"]
    return sorted([(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))
                   for r in out.collect()], key=repr)


def text(pick, n, letters="abcdefgh é"):
    return "".join(pick.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_agrees_with_brute_force(spark, seed):
    pick = random.Random(seed)
    passages = [text(pick, pick.randint(30, 200)) for _ in range(8)]
    passages += [text(pick, 120, "ab"), "ab" * 60, "x" * 300, "abc" * 50]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(pick.randint(0, 4)):
            p = pick.choice(passages)
            a = pick.randrange(len(p) // 2)
            p = p[a:a + pick.randint(20, len(p))]
            if pick.random() < 0.5 and p:  # an edit within the passage
                k = pick.randrange(len(p))
                p = p[:k] + pick.choice(["Z", "", "YY"]) + p[k + 1:]
            parts += [p, text(pick, pick.choice([0, 3, 60]))]
        docs.append((pick.randrange(1000) if seed else i, "".join(parts)))
    assert run(spark, docs) == brute(docs)


def test_defined_cases(spark):
    line = "".join(chr(33 + i % 90) for i in range(70))
    docs = [(5, line), (5, line), (5, line + "tail"), (9, None), (9, ""), (None, line), (7, line[:49]),
            (8, line[:50]), (10, line * 2), (11, "pre" + line[3:60])]
    got = run(spark, docs)
    assert got == brute(docs)
    assert (None, 70, [], line.encode()) in got and (8, 50, [(0, 50)], b"") in got


def test_strings_do_not_cross_documents(spark):
    line = "".join(chr(33 + i % 90) for i in range(80))
    docs = [(1, line[:40]), (2, line[40:]), (3, line)]
    assert all(not x[2] for x in run(spark, docs))


def test_long_documents_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(sub, "CHUNK", 64)  # holds on the driver only, so call the parser here
    pick = random.Random(3)
    data = text(pick, 700, "abc").encode() + b"x" * 300
    starts = []
    for rows, offsets, part, bounds in sub._chunks([data, b"short", data[:51]]):
        found = sub.phrases_of(part, bounds)
        for d, s, n in zip(found["doc"], found["start"], found["starts"]):
            starts += [(int(rows[d]), int(offsets[d] + s + k)) for k in range(n)]
    n = len(data)
    assert sorted(starts) == [(0, i) for i in range(n - N + 1)] + [(2, 0), (2, 1)]


def test_equal_strings_share_trigger_and_side():
    pick = random.Random(1)
    core = text(pick, 90, "abcdefghij").encode()
    found = []
    for _ in range(6):
        data = np.frombuffer(text(pick, 100).encode() + core + text(pick, 100).encode(), np.uint8)
        at = bytes(data).find(core)
        phrases = sub.phrases_of(data, np.array([0, len(data)]))
        of = {}
        for t, s, n in zip(phrases["trigger"], phrases["start"], phrases["starts"]):
            of.update({int(s) + k: int(t) for k in range(n)})
        found.append([of[at + i] for i in range(len(core) - N + 1)])
    assert all(x == found[0] for x in found)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_triggers_are_the_first_trigger_value_or_the_first_least_hash():
    pick = random.Random(5)
    for data in (text(pick, 3000), text(pick, 900, "ab"), "x" * 200, "abc" * 60):
        data = np.frombuffer(data.encode(), np.uint8)
        grams = sub.Rolling(data).fixed(sub.GRAM)
        found = sub.triggers_of(grams)
        assert len(found) == len(data) - N + 1
        for i, at in enumerate(found.tolist()):
            inside = [int(h) for h in grams[i:i + sub.WIDTH]]
            values = [k for k, h in enumerate(inside) if h % sub.PERIOD == 0]
            low = [h % (1 << 43) for h in inside]
            assert at - i == (values[0] if values else low.index(min(low)))


def test_colliding_hashes_delete_nothing(monkeypatch):
    """Phrases that only seem equal are not settled."""
    monkeypatch.setattr(sub.Rolling, "at", lambda self, start, stop: np.zeros(len(start), np.uint64))
    pick = random.Random(7)
    shared = text(pick, 300).encode()
    parts = [shared, text(pick, 300).encode(), shared, shared[:150] + text(pick, 200).encode()]
    data = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.cumsum([0, *map(len, parts)])
    found = sub.phrases_of(data, bounds)
    settled = sub.settled_here(data, found, found["doc"])
    assert settled.any()
    for k in np.flatnonzero(settled).tolist():
        a = int(found["begin"][k])
        piece = bytes(data[a:a + int(found["starts"][k]) - 1 + N])
        assert any(piece in p for p in parts[:int(found["doc"][k])])


def test_repeats_across_many_batches(spark):
    pick = random.Random(9)
    passages = [text(pick, 120) for _ in range(6)]
    docs = [(i, text(pick, 40) + pick.choice(passages) + text(pick, 30)) for i in range(300)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, docs) == brute(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
