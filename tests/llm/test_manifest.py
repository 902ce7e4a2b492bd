import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gavel.llm import manifest
from gavel.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, source string, text string, rank int, `group` string, way string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    """All levels of a tree, from the given nodes up to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain_way(levels, nth):
    """(before, after) of each run on the way up from a node."""
    out = []
    for level in levels[:-1]:
        run = level[nth // 16 * 16:nth // 16 * 16 + 16]
        out.append(("".join(run[:nth % 16]), "".join(run[nth % 16 + 1:])))
        nth //= 16
    return out


def plain(docs):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows (doc_id, source, text, …)."""
    groups = {}
    for doc_id, source, text, *_ in docs:
        groups.setdefault(source, []).append((doc_id, plain_leaf(doc_id, source, text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = plain_levels([leaf for _, leaf in groups[source]])
    top = plain_levels([trees[s][-1][0] for s in order])
    return sorted([(doc_id, leaf, trees[s][-1][0], top[-1][0],
                    [*plain_way(trees[s], n), *plain_way(top, p)])
                   for p, s in enumerate(order) for n, (doc_id, leaf) in enumerate(groups[s])], key=repr)


def build(spark, docs):
    rows = spark.createDataFrame(docs, SCHEMA)
    return manifest.build_manifest(rows, F.col("source"), F.col("doc_id"),
                                   manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "text")]))


def proven(built, requests=None):
    rows = manifest.prove(built, requests).join(built.groups.select("group", "subroot"), "group")
    return sorted([(r["row"]["doc_id"], r["leaf"], r["subroot"], built.root,
                    [tuple(x) for x in r["proof"]]) for r in rows.collect()], key=repr)


def corpus(seed, sizes):
    pick = random.Random(seed)
    docs = [(i, source, "".join(pick.choice("aBé ") for _ in range(pick.randrange(6))), 1, "g", "w")
            for source, n in sizes.items() for i in pick.sample(range(10 * n), n)]
    pick.shuffle(docs)
    return docs


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 1, None: 1}, {"a": 16, "b": 17, "B": 3, None: 2}, {"hot": 300, "é": 257, "z": 1, "": 33},
    {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_agrees_with_plain_trees(spark, sizes):
    docs = corpus(len(sizes), sizes)
    assert proven(build(spark, docs)) == plain(docs)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(None, "a", "x", 1, "g", "w"), (None, "a", None, 1, "g", "w"), (5, "a", "x", 1, "g", "w"),
            (5, "a", "x", 1, "g", "w"), (5, "a", "", 1, "g", "w"), (5, None, None, 1, None, None),
            (7, "a", "long " * 50_000, 1, "g", "w")]
    built = build(spark, docs)
    assert proven(built) == plain(docs)
    assert built.leaves.select("row.rank", "row.group", "row.way").distinct().count() == 2


def test_requests_descend_alone(spark):
    docs = corpus(3, {"hot": 300, "b": 20, "c": 1})
    built = build(spark, docs)
    asked = [("=hot", 0), ("=hot", 299), ("=hot", 299), ("=b", 16), ("=c", 0), ("=b", 99), ("=none", 0)]
    got = proven(built, spark.createDataFrame(asked, "group string, rank long"))
    every = plain(docs)
    assert len(got) == 4 and all(x in every for x in got)


def test_equal_subtrees_share_a_record(spark):
    docs = [(1, "a", "x", 1, "g", "w")] * 64
    built = build(spark, docs)
    assert built.records.count() == 2  # one for all runs of leaves, one for the runs
    assert proven(built) == plain(docs)


def test_tampering_is_found(spark):
    docs = corpus(4, {"a": 50, "b": 3})
    rows = manifest.prove(build(spark, docs))
    changed = manifest.leaf_digest(*[F.col(f"row.{c}") for c in ("doc_id", "source")],
                                   F.concat(F.col("row.text"), F.lit("!")))
    roots = rows.select(manifest.folded(F.col("leaf"), F.col("proof")).alias("fine"),
                        manifest.folded(changed, F.col("proof")).alias("changed")).collect()
    assert {r["fine"] for r in roots} == {plain(docs)[0][3]}
    assert all(r["changed"] != r["fine"] for r in roots)


def test_empty_table(spark):
    built = build(spark, [])
    assert built.root == sha("") and manifest.prove(built).collect() == []


def test_query_on_odd_rows(spark, tmp_path):
    docs = [(None, None, None, None, None), (5, "S", "ABC", "en", 3), (20, "S", "abc", "en", 3), (6, "T", "Q", None, 1)]
    (spark.createDataFrame(docs, "doc_id long, source string, text string, lang string, n_chars long")
     .write.parquet(f"{tmp_path}/documents.parquet"))
    out = op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = {d: not (d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and t != t.lower())
                for d, _, t, _, _ in docs}
    assert {r["doc_id"]: r["verified"] for r in out.collect()} == expected
