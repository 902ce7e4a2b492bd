"""A Merkle manifest of a dataset: digests of rows, runs and groups under one root.

Each row is a leaf. Within its group the leaves lie in a fixed order, and every
``FANOUT`` consecutive nodes become one digest until a single one, the subroot, is left;
the subroots in order of their groups become the root likewise. The digests of a run are
kept in a content-addressed table (digest, children), in which equal subtrees share one
record. A proof is found by descent: from the root on, the digits of a row's rank choose
one child after the other, and the children not chosen are its siblings. Requests that
share leading digits walk that part of the way together, so a level of the descent has
one row for each node of the tree, not one for each request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import is_small, staged, stored
from gavel.operators.ordered import place

#: Bits of a rank that one level takes.
BITS = 4
FANOUT = 1 << BITS

_SEGMENT = "array<struct<before:string,after:string>>"


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of the columns' values, each as its UTF-8 byte count, a
    colon and the text; a null is a hyphen."""
    def field(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: a row per input row: ``group``, ``rank`` (from 0), ``leaf`` and ``row``, its columns.
    ``groups``: a row per group with its ``position``, ``rows``, ``height`` and ``subroot``.
    ``records``: (digest, children). ``height``: levels between root and subroots."""

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame
    root: str
    height: int


def _height(rows: Column) -> Column:
    """Levels above so many leaves: the least h with FANOUT^h >= rows."""
    powers = F.sequence(F.lit(0), F.lit(15))
    return F.array_min(F.filter(powers, lambda h: F.pow(F.lit(FANOUT), h) >= rows))


def _levels(nodes: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(last node of each key, records by level) over ``nodes`` (keys, nth, rows, digest)."""
    tops, records = [nodes.where("rows = 1")], []
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct(
            F.pmod("nth", F.lit(FANOUT)).alias("digit"), F.col("digest"))))
        runs = nodes.where("rows > 1").groupBy(
            *keys, F.shiftright("nth", BITS).alias("nth"),
            F.shiftright(F.col("rows") + (FANOUT - 1), BITS).alias("rows")).agg(
                F.transform(run, lambda x: x["digest"]).alias("children"))
        built = staged(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
        records.append(built.select("digest", "children"))
        nodes = built.drop("children")
        tops.append(nodes.where("rows = 1"))
        most = -(-most // FANOUT)
    last = tops[0]
    for more in tops[1:]:
        last = last.unionByName(more)
    return last.select(*keys, "digest"), records


def build_manifest(rows: DataFrame, group: Column, order: Column, leaf: Column) -> Manifest:
    """The manifest of ``rows``, whose digests are ``leaf``.

    ``group`` is a text; null is a group of its own and the first, the others follow by
    their bytes. Within a group rows lie in the order of ``order``, nulls first; rows that
    tie follow by digest, and rows equal even there may change places, which alters no
    digest. The columns of ``rows`` are carried along as one struct, whatever their names;
    a null digest counts as that of a hyphen. The ranks come from ranges of the whole
    table, so a group of any size is never gathered. An empty table has the digest of the
    empty text as its root.
    """
    spark = rows.sparkSession
    # Sorts a null before all texts.
    key = F.coalesce(F.concat(F.lit("="), group), F.lit("-"))
    read = rows.select(key.alias("group"), order.alias("order"),
                       F.coalesce(leaf, F.sha2(F.lit("-"), 256)).alias("leaf"),
                       F.struct(*[rows[c] for c in rows.columns]).alias("row"))
    placed = place(stored(read), ["group", "order", "leaf"], "_place")
    counted = staged(placed.groupBy("group").agg(F.min("_place").alias("_first"),
                                                 F.count(F.lit(1)).alias("rows")))
    groups = staged(place(counted, ["group"]).withColumns({
        "position": F.col("position") - 1, "height": _height(F.col("rows"))}))
    few = F.broadcast(groups) if is_small(groups) else groups
    leaves = stored(placed.join(few.select("group", "_first", "rows"), "group")
                    .withColumn("rank", F.col("_place") - F.col("_first")).drop("_place", "_first", "order"))

    most, n_groups, top = groups.agg(F.max("rows"), F.count(F.lit(1)), _height(
        F.count(F.lit(1)))).first()
    if not n_groups:
        nothing = spark.createDataFrame([], "digest string, children array<string>")
        root = spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
        return Manifest(leaves.drop("rows"), groups.withColumn("subroot", F.lit("")), nothing, root, 0)
    subroots, records = _levels(leaves.select(
        "group", F.col("rank").alias("nth"), "rows", F.col("leaf").alias("digest")), ["group"], most)
    groups = staged(groups.join(subroots.withColumnRenamed("digest", "subroot"), "group").drop("_first"))
    last, upper = _levels(groups.select(F.col("position").alias("nth"), F.lit(n_groups).alias("rows"),
                                        F.col("subroot").alias("digest")), [], n_groups)
    if records or upper:
        found = [*records, *upper]
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        every = stored(every.dropDuplicates(["digest"]))
    else:
        every = spark.createDataFrame([], "digest string, children array<string>")
    return Manifest(leaves.drop("rows"), groups, every, last.first()["digest"], top)


def _segment(children: Column, digit: Column) -> Column:
    """The children not chosen, as hex text before and after the chosen one."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"),
                    F.array_join(F.slice(children, digit + 2, F.size(children)), "").alias("after"))


def _descend(nodes: DataFrame, records: DataFrame, wanted: DataFrame | None,
             keys: list[str]) -> DataFrame:
    """Nodes (keys, nth, digest, way) one level down, of which some row is requested."""
    below = nodes.join(records, "digest").select(
        *[c for c in nodes.columns if c not in ("nth", "digest", "way")], "way", "nth", "children",
        F.posexplode("children").alias("_digit", "digest")).select(
        *[c for c in nodes.columns if c not in ("nth", "digest", "way")],
        (F.col("nth") * FANOUT + F.col("_digit")).alias("nth"), "digest",
        F.concat("way", F.array(_segment(F.col("children"), F.col("_digit")))).alias("way"))
    return below if wanted is None else below.join(wanted, [*keys, "nth"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Per requested row: group, rank, leaf, row, and ``proof``, its siblings from the bottom up.

    ``requests`` (group, rank, as in the leaves) names rows, None: all. A proof is a list of (before, after):
    the digests left and right of the row's own node in each run, joined; a run of one has
    both empty. Rows of a group that ask twice come once; ranks that don't exist are left out.
    """
    def prefixes(levels: int) -> DataFrame | None:
        if requests is None:
            return None
        return requests.select("group", F.shiftright("rank", BITS * levels).alias("nth")).distinct()

    groups = manifest.groups
    if requests is not None:
        groups = groups.join(requests.select("group").distinct(), "group", "left_semi")
    # Down to the subroots by the digits of the group's position.
    spark = groups.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("nth"), F.lit(manifest.root).alias("digest"),
                                  F.array().cast(_SEGMENT).alias("way"))
    for level in range(manifest.height - 1, -1, -1):
        asked = groups.select(F.shiftright("position", BITS * level).alias("nth")).distinct()
        nodes = staged(_descend(nodes, manifest.records, asked, []))
    here = groups.join(nodes.withColumnRenamed("nth", "position"), "position").select(
        "group", "height", F.lit(0).cast("long").alias("nth"), "digest", "way")
    # Down to the runs of leaves by the digits of the rank; lower groups join in later.
    here = staged(here)
    tallest = here.agg(F.max("height")).first()[0] or 0
    for level in range(tallest, 1, -1):
        deeper = here.where(F.col("height") == level).withColumn("height", F.lit(level - 1))
        here = here.where(F.col("height") < level).unionByName(
            _descend(deeper, manifest.records, prefixes(level - 1), ["group"]))
        here = staged(here)
    runs = here.join(manifest.records, "digest", "left").select("group", "nth", "way", "children")

    leaves = manifest.leaves
    if requests is not None:
        leaves = leaves.join(requests.select("group", "rank").distinct(), ["group", "rank"], "left_semi")
    digit = F.pmod("rank", F.lit(FANOUT)).cast("int")
    # A group of one row has no run: its leaf is the subroot.
    way = F.when(F.col("children").isNull(), F.col("way")).otherwise(
        F.concat("way", F.array(_segment(F.col("children"), digit))))
    met = leaves.withColumn("nth", F.shiftright("rank", BITS)).join(runs, ["group", "nth"])
    return met.select(*leaves.columns, F.reverse(way).alias("proof"))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level from the bottom, left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to.

    A run of one is still a level: its digest is that of its only child.
    """
    return F.aggregate(proof, leaf, lambda d, x: F.sha2(F.concat(x["before"], d, x["after"]), 256))
