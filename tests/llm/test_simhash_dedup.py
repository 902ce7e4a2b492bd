import random

import pytest
import xxhash

from gavel.llm import simhash_dedup as simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root of each distinct fingerprint, by comparing all of them."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1:]:
            if (p ^ q).bit_count() <= 3:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", ["", None, "One", "Éa ÉB", "a b c", "a b c d e f", "x\n\n y\tz  W",
                                  "the same the same the same the same"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def rows(spark, docs):
    out = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string, fp string"))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_documents(spark):
    pick = random.Random(4)
    base = [[f"w{pick.randrange(500)}" for _ in range(200)] for _ in range(6)]
    docs = []
    for i in range(60):
        words = list(pick.choice(base))
        for _ in range(pick.randrange(3)):
            words[pick.randrange(200)] = "other"
        docs.append((i * 3 + 7, " ".join(words), "clash"))
    pick.shuffle(docs)
    prints = {d: plain_fingerprint(t) for d, t, _ in docs}
    roots = plain_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    assert rows(spark, docs) == sorted(
        ((d, f"{p:016x}", least[roots[p]]) for d, p in prints.items()), key=repr)


def test_defined_cases(spark):
    docs = [(5, None, None), (4, "", None), (4, "", None), (None, " \n", None), (None, "alone here now", None)]
    got = rows(spark, docs)
    zero = "0" * 16
    assert [x for x in got if x[1] == zero] == [(4, zero, 4), (4, zero, 4), (5, zero, 4), (None, zero, 4)]
    assert [x[2] for x in got if x[1] != zero] == [None]
    assert rows(spark, [x for x in docs if False]) == []


@pytest.mark.parametrize("limits", [(64, 1024), (3, 1024), (3, 2), (2, 1)])
def test_links_however_long_the_lists(spark, limits):
    pick = random.Random(9)
    prints = set()
    for _ in range(4):
        centre = pick.getrandbits(64)
        for _ in range(40):  # many share bytes, few bits vary
            p = centre
            for _ in range(pick.randrange(5)):
                p ^= 1 << pick.choice([0, 1, 9, 13, 30, 33, 47, 60, 63])
            prints.add(p)
    prints |= {pick.getrandbits(64) for _ in range(50)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = simhash.links(frame, *limits)
    for a, b in links.collect():
        assert (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 3
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    expected = plain_components(prints)
    groups = {}
    for p in prints:
        groups.setdefault(expected[p], set()).add(found.get(signed[p], signed[p]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 120], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(found.get(i, i) == (0 if i <= 120 else 121) for i in range(201))


def test_one_of_each_group_stays(spark):
    docs = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "a b c d", "z"),
            (None, "p q r s", "z"), (None, "p q r s", "z"), (9, None, "n")]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs],
                                  "doc_id long, text string, id string, _hash int, _nth int, row int")
    kept = simhash.drop_near_copies(frame)
    assert kept.columns == ["doc_id", "text", "id", "_hash", "_nth", "row"]
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=repr) == [
        (1, "a b c d", "y"), (9, None, "n"), (None, "p q r s", "z")]
