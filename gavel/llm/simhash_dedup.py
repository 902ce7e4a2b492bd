"""Near copies by 64-bit fingerprints, found through an index of positional bytes.

Two fingerprints with at most three differing bits agree in five or more of their eight
bytes, and so in three bytes of one half. The index lists each distinct fingerprint
under the values of every three bytes of a half, eight lists in all. For each pair that
meets in a list the shared positional bytes are tallied; a pair with fewer than five
can't be close enough, the others are verified bit by bit.

A list with more than ``LIST_ROWS`` fingerprints isn't paired. Its members are listed
again under two more of the other bytes (five agree in any true pair), and where such a
list is still too long, under each way to blank three of the remaining 24 bits: members
that then agree are close for certain, so each only links to the least of them. The
work so stays in proportion to the rows whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import once, staged

WORDS = 3
MAX_BITS = 3
MIN_BYTES = 5
SEED = 42
#: Longest list whose members are paired.
LIST_ROWS = 64
#: Longest list under five bytes whose members are paired.
LONG_LIST_ROWS = 1024


def shingle_hashes(text: str | None, n_words: int = WORDS) -> np.ndarray:
    """64-bit hashes of a text's word shingles in their order.

    A-Z are lower-cased; words are runs without ASCII white space. A text of fewer words
    than a shingle is one shingle; without words, or null, there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    n = max(1, len(words) - n_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[n_words - 1:].tolist() if len(words) >= n_words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)),
                       dtype="<u8", count=n)


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number, 0 without shingles."""
    hashes = shingle_hashes(text)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, n, 4096):
        bits = np.unpackbits(hashes[part:part + 4096].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def _byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _mask(positions: tuple[int, ...]) -> int:
    """Bit mask of these bytes, as a signed 64-bit number."""
    mask = sum(255 << (8 * i) for i in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask



def _listed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint under its bits at each mask."""
    return rows.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _split(listed: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Rows of lists that can be paired, and rows of longer ones."""
    sizes = listed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sized = staged(listed.join(sizes, ["mask", "key"]))
    return sized.where(F.col("rows") <= longest), sized.where(F.col("rows") > longest)


def _pairs(listed: DataFrame) -> DataFrame:
    """Verified links between the members of each list."""
    left = listed.select("mask", "key", F.col("fp").alias("a"))
    right = listed.select(F.col("mask").alias("m"), F.col("key").alias("k"), F.col("fp").alias("b"))
    tally = sum((F.when(_byte("a", i) == _byte("b", i), 1).otherwise(0) for i in range(8)),
                F.lit(0))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return (left.join(right, (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k"))
                      & (F.col("a") < F.col("b")) & (tally >= MIN_BYTES) & close)
            .select("a", "b").distinct())


def links(prints: DataFrame, list_rows: int = LIST_ROWS,
          long_list_rows: int = LONG_LIST_ROWS) -> DataFrame:
    """Pairs (a, b) that connect the distinct fingerprints ``fp`` as all close pairs would."""
    halves = (range(4), range(4, 8))
    triples = [c for half in halves for c in combinations(half, 3)]
    short, long = _split(_listed(prints, [_mask(c) for c in triples]), list_rows)
    found = [_pairs(short)]
    if not long.isEmpty():
        # Under the two further bytes that agree, too.
        fives = [F.lit(_mask(c)) for c in combinations(range(8), MIN_BYTES)]
        wider = F.filter(F.array(*fives), lambda m: m.bitwiseAND(F.col("mask")) == F.col("mask"))
        longer = (long.select("fp", F.explode(wider).alias("mask")).distinct()
                  .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")))
        short, long = _split(longer, long_list_rows)
        found.append(_pairs(short))
        if not long.isEmpty():
            found.append(_blanked(long))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.distinct()


def _blanked(long: DataFrame) -> DataFrame:
    """Links within lists under five bytes, through keys with three more bits blanked.

    Only bits that differ within the list need to be blanked. Members of one key differ
    in no other bits, so each is close to the least of them.
    """
    ones, zeros = F.bit_or("fp"), F.bit_and("fp")
    varied = long.groupBy("mask", "key").agg(ones.bitwiseXOR(zeros).alias("varied"))
    rows = long.join(varied, ["mask", "key"])
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function(
        "bit_get", F.col("varied"), i) == 1)
    rows = once(rows, _bits=F.transform(bits, lambda i: F.call_function(
        "shiftleft", F.lit(1).cast("long"), i)))
    first = rows.select("fp", "mask", "key", "_bits", F.posexplode("_bits").alias("i", "x"))
    second = first.select("fp", "mask", "key", "_bits", "x", F.posexplode(
        F.slice("_bits", F.col("i") + 1, F.size("_bits"))).alias("j", "y"), "i")
    third = second.select("fp", "mask", "key", "x", "y", F.explode(
        F.slice("_bits", F.col("i") + F.col("j") + 1, F.size("_bits"))).alias("z"))
    blank = F.col("x").bitwiseOR(F.col("y")).bitwiseOR(F.col("z"))
    keyed = third.select("fp", "mask", blank.alias("blank"),
                         F.col("fp").bitwiseAND(F.bitwise_not(blank)).alias("rest")).distinct()
    least = keyed.groupBy("mask", "blank", "rest").agg(F.min("fp").alias("least"))
    return (keyed.join(least, ["mask", "blank", "rest"]).where("least < fp")
            .select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node connected to each node that has an edge.

    Alternates two rounds until nothing changes: each node's larger neighbours, then its
    smaller ones, are linked to the least node around it. A round is two small shuffles,
    its edges never outnumber the given ones by much, and chains halve in length.
    """
    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if larger else pairs.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        near = both.join(least, "a")
        if larger:
            return near.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return (near.select(F.col("b").alias("a"), F.col("least").alias("b"))
                .union(least.select("a", F.col("least").alias("b"))).where("a <> b"))

    current, before = staged(edges.distinct()), None
    while True:
        current = staged(stars(stars(current, True).distinct(), False).distinct())
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                list_rows: int = LIST_ROWS, long_list_rows: int = LONG_LIST_ROWS) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Rows are linked if their fingerprints differ in three bits or fewer; a component is
    all that links connect, and its id is the smallest id among its rows. Null and empty
    texts have fingerprint 0, linked like any other. Rows with a null id are part of
    their component but can't name it; if all its ids are null so is the component's.
    Repeated rows are all returned. Other columns are left out. An empty table gives an
    empty one. Copies share a fingerprint and are linked through it once, not in pairs.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = staged(rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long"))
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = staged(components(links(classes.select("fp"), list_rows, long_list_rows)))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(lookup, "fp").select(
        F.col("doc_id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def place_key(id_column: str, text_column: str) -> Column:
    """Orders rows by id, null ids last, then by text hash; repeated rows are equal."""
    return F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                    F.xxhash64(text_column).alias("hash"))


def one_of_each(docs: DataFrame, keys: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``docs`` whose id and text hash are in ``keys``, repeated rows once."""
    marked = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"),
                         F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = marked["id"].eqNullSafe(keys["id"]) & (marked["hash"] == keys["hash"])
    one = Window.partitionBy("id", "hash").orderBy(F.lit(0))
    chosen = marked.join(keys, same, "left_semi").withColumn("nth", F.row_number().over(one))
    return chosen.where("nth = 1").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component of ``near_copies``.

    The row with the smallest id stays, of rows with one id that with the smallest text
    hash, and of repeated rows one. Rows with a null id come after all others. All
    columns are kept.
    """
    key = place_key(id_column, text_column)
    groups = near_copies(docs.select(key.alias("key"), F.col(text_column).alias("text")),
                         "key", "text")
    stays = groups.select("component_id.*").distinct()
    return one_of_each(docs, stays, id_column, text_column)
