"""Bytes that repeat from earlier documents, by prefix-free parsing of the corpus.

A place where a rolling hash of ``GRAM`` bytes is a multiple of ``PERIOD`` is a trigger, and
a phrase is what belongs to one trigger: the strings of ``LENGTH`` bytes whose first trigger
it is, from the first byte of the first of them to the end of the last. A string without a
trigger takes the first of its least hashes for one, so every string lies in one phrase, and
equal strings have equal triggers at equal places.

Distinct phrases are the dictionary, and the documents, in order of id, are the parse.
Equal phrases settle most of the repeats at once: what a phrase holds, it holds also in the
first document with that phrase. Phrases that share a trigger but differ are opened, on the
side on which their bytes next to the trigger agree. Their suffixes, as far as ``LENGTH``
bytes, are sorted over the whole dictionary and, where these are equal, in order of the
parse: neighbours with a common prefix of ``LENGTH`` bytes pass on the first document.

Hashes only choose what is compared. Bytes go because they equal earlier bytes: phrases and
suffixes meet by their content. Two phrases of one trigger with equal hashes of all their
bytes, which differ, may keep a repeat from being seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import stored

LENGTH = 50
GRAM = 20
#: One place of so many is a trigger.
PERIOD = 20
#: Bytes beside the trigger that phrases must share to be opened on that side.
SIDE = (LENGTH - GRAM) // 2
#: Places in a string where a trigger may stand, which is also the most strings of a phrase.
WIDTH = LENGTH - GRAM + 1
#: Strings worked on at once.
CHUNK = 1 << 20
#: Rows sent out at once.
ROWS = 1 << 14

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASES = (_BASE, _U(0xD1342543DE82EF95 | 1))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Two random 64-bit numbers for each byte value."""
    numbers = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
    return numbers[0], numbers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Polynomial hashes of any stretch of a buffer, modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data) + 1
        up, down = self._of(which, n)
        self._down = down
        self._sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_tables()[which][data] * up[:n - 1], out=self._sums[1:])

    @classmethod
    def _of(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            base = int(_BASES[which])
            inverse = _U(pow(base, -1, 1 << 64))
            size = max(n, CHUNK + 1)
            up, down = np.full(size, _BASES[which]), np.full(size, inverse)
            up[0] = down[0] = 1
            have = cls._powers[which] = np.cumprod(up), np.cumprod(down)
        return have

    def fixed(self, length: int) -> np.ndarray:
        """Hash of each stretch of ``length``."""
        return _mixed((self._sums[length:] - self._sums[:-length])
                      * self._down[:len(self._sums) - length])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[stop] - self._sums[start]) * self._down[start]
                      + (stop - start).astype(np.uint64))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return x if size == width else np.minimum(x[:size - width], x[width - size:])


def _segments(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Row, offset and bytes of each document, long ones in parts that share no string."""
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            yield row, at, text[at:at + CHUNK + LENGTH - 1]


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A few documents at a time: rows, offsets, bytes and bounds."""
    taken: list[tuple[int, int, bytes]] = []
    size = 0
    for part in [*_segments(texts), None]:
        if taken and (part is None or size + len(part[2]) > CHUNK):
            rows, offsets, parts = zip(*taken)
            yield (np.array(rows), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8),
                   np.cumsum([0, *map(len, parts)]))
            taken, size = [], 0
        if part is not None:
            taken.append(part)
            size += len(part[2])


def triggers_of(grams: np.ndarray) -> np.ndarray:
    """For each string the place of its trigger, by the hashes of its grams."""
    n, at = len(grams) - WIDTH + 1, np.arange(len(grams))
    nearest = np.where(grams % _U(PERIOD) == 0, at, len(grams) + WIDTH)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1][:n]
    # Hash and place in one number: the least is the first of the least hashes.
    places = _U(21)  # a chunk has fewer than 2^21 of them
    least = _sliding_least((grams << places) | at.astype(np.uint64), WIDTH)
    least = (least & _U((1 << 21) - 1)).astype(np.int64)
    return np.where(nearest < at[:n] + WIDTH, nearest, least)


def phrases_of(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of the documents between ``bounds`` of a buffer.

    ``trigger`` is the trigger's hash, ``phrase`` a hash of the phrase's bytes with 12 bits
    each of its left and right side, ``begin`` its place in the buffer and ``start`` in the
    document, ``starts`` how many strings it has, ``to_trigger`` the trigger's distance.
    """
    rolling = Rolling(data)
    grams = rolling.fixed(GRAM)
    trigger = triggers_of(grams)
    valid = np.ones(len(trigger), dtype=bool)
    for b in bounds[1:-1]:  # strings that would cross into the next document
        valid[max(b - LENGTH + 1, 0):b] = False
    same = (trigger[1:] == trigger[:-1]) & valid[1:] & valid[:-1]
    begin = np.flatnonzero(valid & ~np.append(False, same))
    stop = np.flatnonzero(valid & ~np.append(same, False)) + 1
    doc = np.searchsorted(bounds, begin, side="right") - 1
    place, end = trigger[begin], stop - 1 + LENGTH
    # A side counts if some string of the phrase reaches it whole.
    left, right = place - begin >= SIDE, end - (place + GRAM) >= SIDE
    side_left = rolling.at(np.where(left, place - SIDE, 0), np.where(left, place + GRAM, 1))
    side_right = rolling.at(np.where(right, place, 0), np.where(right, place + GRAM + SIDE, 1))
    bits = lambda use, h: np.where(use, _U(1) + h % _U(4095), _U(0))
    sides = (bits(left, side_left) << _U(12)) | bits(right, side_right)
    whole = rolling.at(begin, end) & ~_U((1 << 24) - 1)
    return {"doc": doc, "trigger": grams[place].view(np.int64),
            "phrase": (whole | sides).view(np.int64), "begin": begin,
            "start": begin - bounds[doc], "starts": stop - begin, "to_trigger": place - begin}


def _place(start: np.ndarray, starts: np.ndarray, to_trigger: np.ndarray) -> np.ndarray:
    return (start << 16) | (starts << 8) | to_trigger


def settled_here(data: np.ndarray, found: dict[str, np.ndarray], rank: np.ndarray) -> np.ndarray:
    """Which phrases stand, byte by byte, also in a document of the same buffer whose
    ``rank`` is lower."""
    order = np.lexsort((rank, found["phrase"]))
    phrase, size = found["phrase"][order], LENGTH + WIDTH
    new = np.append(True, phrase[1:] != phrase[:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = rank[order] > rank[first]
    row, first = order[later], first[later]
    settled = np.zeros(len(order), dtype=bool)
    for i in range(0, len(row), ROWS):
        a, b = row[i:i + ROWS], first[i:i + ROWS]
        length, each = found["starts"][a] - 1 + LENGTH, np.arange(size)
        x, y = (data[np.minimum(found["begin"][r][:, None] + each, len(data) - 1)] for r in (a, b))
        equal = ((x == y) | (each >= length[:, None])).all(axis=1)
        settled[a] = equal & (found["starts"][a] == found["starts"][b])
    return settled


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each document, ``place`` doubled and one more for settled ones. These need
    not meet the others of their trigger and are spread."""
    names = ["doc", "text_hash", "trigger", "phrase", "place"]
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())]
        ranks = np.asarray(pc.rank(batch.column("doc"), tiebreaker="dense"), dtype=np.int64)
        for rows, offsets, data, bounds in _chunks(texts):
            found = phrases_of(data, bounds)
            at = rows[found["doc"]]
            settled = settled_here(data, found, ranks[at])
            source = pa.array(at)
            place = _place(found["start"] + offsets[found["doc"]], found["starts"],
                           found["to_trigger"])
            spread = _mixed(place.astype(np.uint64) + (at.astype(np.uint64) << _U(48)))
            trigger = np.where(settled, spread.view(np.int64), found["trigger"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(source), batch.column("text_hash").take(source),
                 pa.array(trigger), pa.array(found["phrase"]), pa.array(place * 2 + settled)],
                names=names)


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of marked phrases that are not settled yet."""
    unpack = zstandard.ZstdDecompressor()
    names = ["piece", "mark", "doc", "text_hash"]
    for batch in batches:
        pieces, marked, rows = [], [], []

        def made() -> pa.RecordBatch:
            row = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.binary()), pa.array(marked, pa.int64()),
                 batch.column("doc").take(row), batch.column("text_hash").take(row)], names=names)

        for i, marks in enumerate(batch.column("marks")):
            if not marks.is_valid:
                continue
            marks = np.asarray(marks.values, dtype=np.int64)
            marks = marks[marks & 1 == 0]
            if not len(marks):
                continue
            text = unpack.decompress(batch.column("packed")[i].as_py())
            starts = (marks >> 19).tolist()
            ends = ((marks >> 19) + ((marks >> 11) & 255) - 1 + LENGTH).tolist()
            for k in range(0, len(starts), ROWS):
                part = slice(k, k + ROWS)
                pieces += [text[a:b] for a, b in zip(starts[part], ends[part])]
                marked += marks[part].tolist()
                rows += [i] * len(starts[part])
                if len(rows) >= ROWS:
                    yield made()
                    pieces, marked, rows = [], [], []
        if rows:
            yield made()


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of opened phrases, as far as ``LENGTH`` bytes, with their start and document."""
    for batch in batches:
        pieces, marks = batch.column("piece"), np.asarray(batch.column("mark"), dtype=np.int64)
        begins = np.frombuffer(pieces.buffers()[1], np.int32)[
            pieces.offset:pieces.offset + len(pieces)].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        offset, side = (marks >> 3) & 255, (marks >> 1) & 3
        # Left only: strings that reach SIDE bytes or more before the trigger; right alike.
        low = np.where(side == 2, np.maximum(offset + GRAM + SIDE - LENGTH, 0), 0)
        high = (marks >> 11) & 255
        high = np.where(side == 1, np.minimum(offset - SIDE + 1, high), high)
        counts = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(marks)), counts)
        each = low[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        for i in range(0, len(row), ROWS):
            r, k = row[i:i + ROWS], each[i:i + ROWS]
            strings = data[(begins[r] + k)[:, None] + np.arange(LENGTH)]
            bounds = np.arange(0, LENGTH * len(r) + 1, LENGTH, dtype=np.int32)
            suffix = pa.Array.from_buffers(
                pa.binary(), len(r), [None, pa.py_buffer(bounds), pa.py_buffer(strings)])
            taken = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [suffix, pa.array((marks[r] >> 19) + k), batch.column("doc").take(taken),
                 batch.column("text_hash").take(taken)],
                names=["suffix", "at", "doc", "text_hash"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [pack.compress(x.as_buffer().to_pybytes())
                  for x in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(packed, pa.binary()), batch.column("text_hash")],
            names=["doc", "packed", "text_hash"])


def covered_spans(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans covered by strings of ``LENGTH`` at ``counts`` starts from each start."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], (starts + counts - 1 + LENGTH)[order]
    if not len(low):
        return []
    reach = np.maximum.accumulate(high)
    begins = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
    ends = np.append(begins[1:] - 1, len(low) - 1)
    return list(zip(low[begins].tolist(), reach[ends].tolist()))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_bytes", "spans", "kept"]
    for batch in batches:
        sizes, spans, kept = [], [], []
        for packed, marks, later in zip(*(batch.column(c) for c in ("packed", "marks", "later"))):
            text = unpack.decompress(packed.as_py())
            marks = np.asarray(marks.values if marks.is_valid else [], dtype=np.int64)
            later = np.asarray(later.values if later.is_valid else [], dtype=np.int64)
            stretches = np.append(marks[marks & 1 == 1] >> 11, later)
            found = covered_spans(stretches >> 8, stretches & 255)
            rest, at = [], 0
            for a, b in found:
                rest.append(text[at:a])
                at = b
            sizes.append(len(text))
            spans.append([{"start": a, "stop": b} for a, b in found])
            kept.append(b"".join([*rest, text[at:]]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, span),
             pa.array(kept, pa.binary())], names=names)


def _marks(parse: DataFrame) -> DataFrame:
    """Phrases to look at, as ``mark``: place, two bits of the sides to open (1 left, 2 right)
    and one that tells settled phrases.

    Kept are settled phrases, those that seem to repeat from an earlier document, the first
    of these, and those that agree on a side with another phrase of their trigger. All steps
    are windows within a trigger, so the parse is shuffled once. Phrases that repeat within
    a chunk of documents are settled there, so that a common passage sends one row a chunk.
    The windows that look at a whole trigger spill beyond memory.
    """
    spread = parse.repartition("trigger")
    trigger, phrase = Window.partitionBy("trigger"), Window.partitionBy("trigger", "phrase")
    past = phrase.orderBy("doc").rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.withColumns({
        "first": F.first("doc").over(past), "nth": F.row_number().over(phrase.orderBy("doc")),
        "next": F.lead("doc").over(phrase.orderBy("doc"))})
    rows = rows.withColumns({
        "low": F.min("doc").over(trigger), "high": F.max("doc").over(trigger),
        "one": F.min("phrase").over(trigger), "other": F.max("phrase").over(trigger)})
    settled = F.col("place").bitwiseAND(F.lit(1))
    equal = F.col("doc") > F.col("first")
    repeats = equal | ((F.col("nth") == 1) & F.col("next").isNotNull())
    rows = rows.where((settled == 1) | ((F.col("low") < F.col("high"))
                                        & (repeats | (F.col("one") != F.col("other")))))
    sides = F.col("phrase").bitwiseAND(F.lit((1 << 24) - 1))
    rows = rows.select("trigger", "doc", "text_hash", F.shiftright("place", 1).alias("place"),
                       settled.alias("settled"), equal.alias("equal"), repeats.alias("repeats"),
                       (F.col("nth") == 1).cast("int").alias("kind"),
                       F.shiftright(sides, 12).alias("left"),
                       sides.bitwiseAND(F.lit(4095)).alias("right"))
    rows = rows.withColumns({
        "lefts": F.sum("kind").over(Window.partitionBy("trigger", "left")),
        "rights": F.sum("kind").over(Window.partitionBy("trigger", "right"))})
    side = (F.when((F.col("left") > 0) & (F.col("lefts") > 1), 1).otherwise(0)
            + F.when((F.col("right") > 0) & (F.col("rights") > 1), 2).otherwise(0))
    # What seems to repeat is opened whole if its bytes turn out to differ.
    rows = rows.withColumn("side", F.when(F.col("equal"), 3).otherwise(side))
    mark = F.shiftleft("place", 3) + F.shiftleft("side", 1) + F.col("settled")
    return (rows.where("settled = 1 or repeats or side > 0")
            .select("doc", "text_hash", mark.alias("mark")))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes``, ``spans`` (start, stop) removed, and ``kept`` bytes.

    A byte of the UTF-8 text is removed if a string of ``LENGTH`` bytes covers it that
    also starts in a document with a smaller id; strings are judged on the input and
    never cross documents. A null text is empty. Rows with a null id stay whole and
    remove nothing; rows that repeat an id don't remove from each other. Other columns
    are left out, and an empty table gives an empty one. The rows should come from files or
    another source that keeps their order when a lost task reads them again.
    """
    rows = docs.select(F.col(id_column).alias("doc"),
                       F.coalesce(text_column, F.lit("")).alias("text"))
    # Tells rows apart that repeat an id; mostly none do, and nothing is carried.
    repeated = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("text_hash", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    kind = rows.schema["doc"].dataType.simpleString()
    parse = rows.where("doc is not null").mapInArrow(
        _parse, f"doc {kind}, text_hash long, trigger long, phrase long, place long")
    marks = stored(_marks(parse).groupBy("doc", "text_hash")
                   .agg(F.collect_list("mark").alias("marks")))
    # The parse's shuffle is gone by now.
    packed = rows.mapInArrow(_pack, f"doc {kind}, packed binary, text_hash long")
    marked = packed.join(marks, ["doc", "text_hash"], "left").select(
        "doc", "text_hash", "packed", "marks")
    # Phrases meet by their bytes, and only their first document's are opened.
    pieces = marked.where("marks is not null").mapInArrow(
        _dictionary, f"piece binary, mark long, doc {kind}, text_hash long").repartition("piece")
    past = (Window.partitionBy("piece").orderBy("doc")
            .rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("first", F.first("doc").over(past)).select(
        "doc", "text_hash", "mark", (F.col("doc") > F.col("first")).alias("again"),
        F.when((F.col("doc") == F.col("first")) & (F.col("mark") % 8 > 0), F.col("piece"))
        .alias("piece"))
    # Stored, so that the shuffles of whole texts and phrases are gone before suffixes come.
    pieces = stored(pieces.where("again or piece is not null"))
    again = pieces.where("again").select(
        "doc", "text_hash", F.shiftright("mark", 11).alias("stretch"))
    opened = pieces.where("piece is not null").select("piece", "mark", "doc", "text_hash")
    suffixes = opened.mapInArrow(
        _suffixes, f"suffix binary, at long, doc {kind}, text_hash long").repartitionByRange("suffix")
    in_order = (Window.partitionBy("suffix").orderBy("doc")
                .rowsBetween(Window.unboundedPreceding, 0))
    later = (suffixes.withColumn("first", F.first("doc").over(in_order)).where("doc > first")
             .select("doc", "text_hash", (F.shiftleft("at", 8) + 1).alias("stretch")))
    later = stored(again.union(later).groupBy("doc", "text_hash")
                   .agg(F.collect_list("stretch").alias("later")))
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    done = marked.join(later, ["doc", "text_hash"], "left").select(
        "doc", "packed", "marks", "later").mapInArrow(_remove, schema)
    return done.withColumnRenamed("doc_id", id_column)
