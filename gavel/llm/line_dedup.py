"""Lines that occur earlier in the corpus, exactly or within one word.

A line is a list of tokens, the pieces between single spaces once white space at both
ends is cut off. Two lines match if they are equal, or if both have ``min_tokens`` or
more and one insertion, deletion or replacement of a token makes them equal.

Deletion neighbourhoods find the matches: a line stands for itself and for each
variant with one token left out, and matching lines share a variant. Three things
keep that linear. Only distinct lines are expanded, and of these only lines that share
their first or last half with another one, which every match does. A variant's key is
the xor of its tokens' hashes, so all keys of a line take one pass. The pairs of a
variant are never formed: lines that lose a token at the same place of the same
variant all match each other, so the earliest of them decides for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import is_small, once, staged, stored

MIN_TOKENS = 8
ID = ["h1", "h2"]


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("line")).alias("h2")]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with a token: document, hash of its text, place and the trimmed line."""
    body = F.col(text)
    return (docs.where(F.col(key).isNotNull() & body.isNotNull())
            .select(F.col(key).alias("doc"), F.xxhash64(body).alias("text_hash"),
                    F.posexplode(F.split(body, "\n")).alias("no", "raw"))
            .select("doc", "text_hash", "no", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
            .where("line <> ''"))


def _halves(line: Column, n: Column) -> Column:
    """Keys of the first and last halves; lengths n and n + 1 have one length in common."""
    def key(tag: str, words: Column) -> Column:
        return F.xxhash64(F.lit(tag), F.substring_index(line, " ", words))

    cuts = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    return F.flatten(F.transform(cuts, lambda c: F.array(
        F.call_function("xxhash64", F.lit("head"), F.call_function("substring_index", line, F.lit(" "), c)),
        F.call_function("xxhash64", F.lit("tail"), F.call_function("substring_index", line, F.lit(" "), -c)))))


def _near_firsts(docs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """Per line with a match within one token: the earliest place of any of its matches."""
    # Each distinct line sends its halves once, however often it occurs. Both readers of a
    # spread table share its shuffle.
    halves = (distinct.where("keys is not null").select(*ID, F.explode("keys").alias("half"))
              .repartition("half"))
    shared = (halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
              .where("a <> b").select("half"))
    candidates = halves.join(shared, "half", "left_semi").select(*ID).distinct()
    places = stored(distinct.join(candidates, ID).select(*ID, "first"))

    # The text of each candidate, from the place where it occurs first.
    wanted = (places.groupBy(F.col("first.doc").alias("doc"))
              .agg(F.collect_set("first.no").alias("numbers")))
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted
    body = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.col(text).alias("body"))
    found = (body.join(wanted, "doc").select(
        "numbers", F.posexplode(F.split("body", "\n")).alias("no", "raw"))
        .where(F.array_contains("numbers", F.col("no")))
        .select(F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line")))
    found = found.select(*_identity(F.col("line")), "line").dropDuplicates(ID)
    texts = stored(found.join(places, ID).select(*ID, "first", F.split("line", " ").alias("tokens")))

    hashed = once(texts, _hashes=F.transform("tokens", lambda t: F.xxhash64(t)))
    summed = once(hashed, _all=F.aggregate(
        "_hashes", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(h)))
    n = F.size("tokens")
    variants = F.concat(
        F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64(n, F.col("_all")).alias("key"))),
        F.transform("_hashes", lambda h, i: F.struct(
            i.alias("at"), F.xxhash64(n - 1, F.col("_all").bitwiseXOR(h)).alias("key"))))
    rows = summed.select("h1", F.inline(variants).alias("at", "key")).repartition("key")
    again = (rows.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
             .where("a <> b").select("key"))
    meeting = (rows.join(again, "key", "left_semi")
               .groupBy("h1").agg(F.collect_set("at").alias("places")))

    # Verification by the variant's whole text: equal variants that lack a token at the
    # same place are one replacement apart, and a whole line equal to one is a deletion.
    at = F.col("at")
    rest = F.when(at < 0, F.array_join("tokens", " ")).otherwise(F.array_join(F.concat(
        F.slice("tokens", F.lit(1), F.greatest(at, F.lit(0))),
        F.slice("tokens", at + 2, F.size("tokens"))), " "))
    left = texts.join(meeting, "h1").select(
        *ID, "first", F.explode("places").alias("at"), "tokens")
    left = staged(once(left, _rest=rest).select(
        *ID, "first", "at", F.xxhash64("_rest").alias("r1"),
        F.xxhash64("_rest", F.lit("rest")).alias("r2")))
    cut, whole = left.where("at >= 0"), left.where("at < 0")
    by_place = cut.groupBy("r1", "r2", "at").agg(F.min("first").alias("near"))
    by_rest = cut.groupBy("r1", "r2").agg(F.min("first").alias("near"))
    wholes = whole.groupBy("r1", "r2").agg(F.min("first").alias("near"))
    near = (cut.join(by_place, ["r1", "r2", "at"]).select(*ID, "near")
            .union(cut.join(wholes, ["r1", "r2"]).select(*ID, "near"))
            .union(whole.join(by_rest, ["r1", "r2"]).select(*ID, "near")))
    return near.groupBy(*ID).agg(F.min("near").alias("near"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The rows of ``docs`` with repeated lines cut from the text, ``n_lines``, ``n_removed``.

    A line is removed if a matching line stands at an earlier place of the corpus, in
    order of (id, line number); matches are judged on the input, not on what is left.
    Lines without a token are never removed. All input columns are kept, also those
    named like the two counts, which then are replaced. Rows with a null text have 0
    lines and stay null; rows with a null id stay whole and remove nothing. Rows that
    repeat an id share places: neither removes a line of the other at the same place,
    and each loses lines that occur at an earlier place of either. An empty table gives
    an empty one. A document may lose all its lines; its text is then empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = _lines(docs, id_column, text_column)
    n = F.size(F.split("line", " "))
    # The hashes of the halves are made before the shuffle, which so carries no text.
    place = F.struct("doc", "no")
    seen = stored(lines.select("doc", "text_hash", "no", *_identity(F.col("line")),
                               F.when(n >= min_tokens, _halves(F.col("line"), n)).alias("keys")))
    distinct = stored(seen.groupBy(*ID).agg(F.min(place).alias("first"),
                                            F.count(F.lit(1)).alias("times"),
                                            F.first("keys").alias("keys")))
    near = _near_firsts(docs, distinct, id_column, text_column)
    decided = (distinct.join(near, ID, "left")
               .select(*ID, F.coalesce(F.least("first", "near"), "first").alias("earliest"),
                       ((F.col("times") > 1) | F.col("near").isNotNull()).alias("matched"))
               .where("matched").drop("matched"))
    removed = (seen.select("doc", "text_hash", "no", *ID).join(decided, ID)
               .where(place > F.col("earliest"))
               .groupBy("doc", "text_hash").agg(F.collect_set("no").alias("gone")))

    # The input is carried as one struct, so its names can't clash with those used here.
    rows = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text_column).alias("text_hash"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(removed, ["doc", "text_hash"], "left")
    body, gone = F.col("row").getField(text_column), F.col("gone")
    pieces = F.split(body, "\n")
    kept = F.when(gone.isNull(), body).otherwise(F.array_join(F.filter(
        pieces, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    columns = [(kept if c == text_column else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return joined.select(
        *columns, F.coalesce(F.size(pieces), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
