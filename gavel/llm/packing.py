"""Documents packed into few sequences of bounded length by bin completion.

Only lengths matter for packing, and there are at most as many as a sequence is long.
So the tables never meet the search: their lengths are counted, the search runs on that
bounded histogram, and its fillings are dealt out to the pieces by their rank among
pieces of one length. A filling is used as often as the counts allow, which keeps the
number of fillings near the number of lengths whatever the number of documents.

Bin completion takes the largest length left and looks for a filling of the rest of the
sequence. Fillings are enumerated with larger pieces first, so those that others
dominate by exchanging pieces for larger ones come late or never, and a branch is cut
when it can't waste less than the best filling so far, which starts as the best fit.
Across sequences the search branches over the best fillings, and gives up a branch when
the waste so far leaves it no chance to use fewer sequences than the incumbent.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import insort
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import staged

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Steps of the search for one filling, and paths tried. Beyond them the best found so
#: far is taken; every piece is packed in any case.
FILL_STEPS = 500
BRANCHES = 8
#: Pieces and words kept with their ids in a worker, and the longest such one.
CACHED_WORDS, CACHED_CHARS = 450_000, 48
#: Pieces that a worker holds before it sends them on.
SENT_PIECES = 2048

#: Words of these characters need no normalisation but lower case, and split alike.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile("[!-~À-ÖØ-öø-ÿ \n\t\r]*")
# The tokenizer's pieces of a text, here of plain characters.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \n\t\r]+")
#: Byte-level BPE writes bytes as letters: printable Latin-1 as itself, others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class _Pieces(dict[str, bytes]):
    """Ids of pieces of plain characters, merged by the tokenizer's model when first met."""

    def __init__(self, merge: Callable):
        super().__init__()
        self._merge = merge

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        ids = array("I", [t.id for t in self._merge(shown)]).tobytes()
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


class WordTokenizer:
    """A tokenizer whose words end at spaces, with the ids of pieces kept as bytes.

    Its splitting drops white space and joins nothing across it, so a text's ids are
    those of its space-separated words in turn, and of their pieces. Texts of plain
    characters are lowered and split into pieces here, and only merged by the tokenizer's
    model, which is done once for each piece kept: there are fewer of them than of words,
    which differ by case and marks. Other texts are split into words. Those of plain
    characters are treated alike; any other, and any that may hold a special token, goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._pieces = _Pieces(self._tokenizer.model.tokenize)
        self._ids: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, _PIECES.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            ids = self._tokenizer.encode(word, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        return self._plain(word)

    def encode(self, text: str) -> bytes:
        """Ids as unsigned little-endian 32-bit numbers."""
        known = self._ids
        if len(known) + len(self._pieces) > CACHED_WORDS:
            known.clear()
            self._pieces.clear()
        if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        missing = set(words).difference(known)
        if not missing:
            return b"".join(map(known.__getitem__, words))
        learned = {w: self._word(w) for w in missing}
        known.update((w, ids) for w, ids in learned.items() if len(w) <= CACHED_CHARS)
        return b"".join([learned[w] if w in learned else known[w] for w in words])


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int,
         with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = WordTokenizer(path)
    for batch in batches:
        source, piece, start, length, crc, ids = [], [], [], [], [], []

        def made() -> pa.RecordBatch:
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for row, text in enumerate(batch.column(1)):
            data = tokenizer.encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at:at + 4 * capacity]
                source.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                if len(source) >= SENT_PIECES:
                    yield made()
                    for column in (source, piece, start, length, crc, ids):
                        column.clear()
        if source:
            yield made()


def cut_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               tokenizer: str | None = None, capacity: int = CAPACITY,
               with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (, ``ids``).

    A document is the ids of its text and ``END_ID``; a null or empty text is the end
    alone. Only documents longer than ``capacity`` are cut. ``tokenizer`` is the path
    of a word tokenizer's file that every executor has.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    cut = partial(_cut, path=str(path), capacity=capacity, with_ids=with_ids)
    return rows.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


class Stock:
    """Pieces left, as counts per length and a bit set of the lengths present."""

    def __init__(self, counts: Mapping[int, int]):
        self.counts = {length: n for length, n in counts.items() if n > 0}
        self._present = sum(1 << length for length in self.counts)

    def largest(self, bound: int) -> int:
        """Largest length present up to ``bound``, or 0."""
        return max((self._present & ((2 << max(bound, 0)) - 1)).bit_length() - 1, 0)

    def take(self, length: int, times: int = 1) -> None:
        self.counts[length] -= times
        if not self.counts[length]:
            self._present ^= 1 << length

    def put(self, length: int) -> None:
        if not self.counts[length]:
            self._present ^= 1 << length
        self.counts[length] += 1


def completions(stock: Stock, room: int, keep: int, steps: int = FILL_STEPS) -> list[tuple[int, ...]]:
    """Up to ``keep`` fillings of ``room``, least waste first.

    The first one found is the best fit. A filling that could take another piece is
    dominated and left out.
    """
    best: list[tuple[int, tuple[int, ...]]] = []
    taken: list[int] = []
    space, length, used = room, stock.largest(room), 1
    if not length:
        best.append((space, ()))
    # A loop, since a filling of short documents has more pieces than calls may nest.
    while length or taken:
        if length and not (best and (used > steps or len(best) == keep and not best[-1][0])):
            stock.take(length)
            taken.append(length)
            space -= length
            used += 1
            length = stock.largest(min(space, length))
            if not length and not stock.largest(space):
                if len(best) < keep or space < best[-1][0]:
                    insort(best, (space, tuple(taken)))
                    del best[keep:]
        elif taken:
            length = taken.pop()
            stock.put(length)
            space += length
            length = stock.largest(length - 1)
        else:
            break
    return [taken for _, taken in best]


def least_sequences(counts: Mapping[int, int], capacity: int) -> int:
    """No packing uses fewer: pieces over half a sequence each need one of their own, and
    for each k the pieces of k to a half must fit beside those or into further ones."""
    n = np.zeros(capacity + 1, dtype=object)
    for length, times in counts.items():
        n[length] = times
    number, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, most = capacity // 2, 0
    for k in range(half + 1):
        alone = number[capacity] - number[capacity - k]
        beside = number[capacity - k] - number[half]
        free = beside * capacity - (size[capacity - k] - size[half])
        small = size[half] - (size[k - 1] if k else 0)
        most = max(most, alone + beside + max(0, -((free - small) // capacity)))
    return int(most)


Filling = tuple[tuple[int, ...], int]


def _descend(counts: Mapping[int, int], capacity: int, waste: int, turn: int,
             steps: int) -> list[Filling] | None:
    """One path of the search: lengths of a sequence, and how many sequences are so.

    Takes the second best filling at step ``turn``, else the best. None if the waste
    exceeds ``waste``, so that the path can't beat the incumbent.
    """
    stock, made = Stock(counts), []
    while length := stock.largest(capacity):
        stock.take(length)
        found = completions(stock, capacity - length, 2 if len(made) == turn else 1, steps)
        stock.put(length)
        filling = (length, *found[-1 if len(made) == turn else 0])
        each = Counter(filling)
        times = min(stock.counts[x] // k for x, k in each.items())
        if len(made) == turn:
            times = 1
        for x, k in each.items():
            stock.take(x, k * times)
        made.append((filling, times))
        if stock.largest(capacity):  # the last sequence may stay open
            waste -= (capacity - sum(filling)) * times
            if waste < 0:
                return None
    return made


def complete_bins(counts: Mapping[int, int], capacity: int = CAPACITY,
                  branches: int = BRANCHES) -> list[Filling]:
    """Fillings of sequences that use up ``counts`` (pieces per length), few sequences."""
    total = sum(length * n for length, n in counts.items())
    least = least_sequences(counts, capacity)

    def used(fillings: list[Filling]) -> int:
        return sum(times for _, times in fillings)

    # With a single step per filling, each is the best fit.
    best = _descend(counts, capacity, total + capacity * sum(counts.values()), -1, 1) or []
    for turn in range(-1, branches):
        if used(best) <= least or turn > len(best):
            break
        found = _descend(counts, capacity, (used(best) - 1) * capacity - total, turn, FILL_STEPS)
        if found and used(found) < used(best):
            best = found
    return best


def _slots(fillings: list[Filling], capacity: int) -> dict[str, np.ndarray]:
    """Per filling and length: the ranks it takes among pieces of that length, and where to.

    Ranks are offset by length times 2^40, so one sorted array serves all lengths.
    """
    rows, taken, first = [], Counter(), 0
    for filling, times in fillings:
        offset = 0
        for length, each in sorted(Counter(filling).items(), reverse=True):
            rows.append(((length << 40) + taken[length], first, each, offset, length))
            taken[length] += each * times
            offset += each * length
        first += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("rank", "sequence", "each", "offset", "length"), columns))


def _deal(batches: Iterator[pa.RecordBatch], slots: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        length = batch.column("length").to_numpy()
        at = np.searchsorted(slots["rank"], (length << 40) + rank, side="right") - 1
        nth = (length << 40) + rank - slots["rank"][at]
        each = slots["each"][at]
        names = [x for x in batch.schema.names if x != "rank"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in names]
            + [pa.array(slots["sequence"][at] + nth // each),
               pa.array(slots["offset"][at] + nth % each * slots["length"][at])],
            names=[*names, "sequence_id", "offset"])


def _ranked(pieces: DataFrame) -> DataFrame:
    """Place of each piece among those of its length, without gathering a length in a task.

    Pieces are numbered within each partition of the staged rows, of which there are
    many for a frequent length, and the counts of earlier partitions are added.
    """
    parts = pieces.withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_part")
    before = sizes.select("length", "_part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = parts.withColumn("_nth", F.row_number().over(within) - 1)
    return numbered.join(before, ["length", "_part"]).withColumn(
        "rank", F.col("before") + F.col("_nth")).drop("_part", "before", "_nth")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   tokenizer: str | None = None, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece of a document with its ``sequence_id`` and ``offset`` there.

    See ``cut_pieces`` for the other columns. Sequences are numbered from 0 and filled
    without gaps from offset 0. Rows with equal or null ids are packed as they come;
    other columns are left out. An empty table gives an empty one.

    What reaches the driver is one count per length, ``capacity`` of them at most.
    """
    pieces = staged(cut_pieces(docs, id_column, text_column, tokenizer, capacity, with_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(complete_bins(counts, capacity), capacity)
    ranked = _ranked(pieces)
    columns = [f for f in ranked.schema if f.name != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    return ranked.mapInArrow(partial(_deal, slots=slots),
                             schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` and ``length``; needs ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
            .withColumn("length", F.size("ids")))
