"""Language by compression: the dictionary that makes a text smallest names its language.

For each language a zstandard raw-content dictionary is filled with sample text. A text
is reduced to its lower-case letter runs, cut into blocks, and each block is compressed
against each dictionary; the language with the smallest sum wins. Blocks keep a long
text from serving as its own dictionary. A text whose two best sums are too close, such
as a very short or a mixed one, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import ready

UNKNOWN = "und"
LEVEL = 6
BLOCK_BYTES = 1024
DICTIONARY_BYTES = 112_000
#: Least saving of the best dictionary over the second best, as a share of the latter.
MIN_MARGIN = 0.01
#: The classifier is fitted on so many labelled rows a language, chosen by hash, and on
#: a slice of so many characters, at a place chosen by hash, of each.
SAMPLE_ROWS, SAMPLE_CHARS = 160, 1500
#: Languages learned at most; more labels than these are an error.
MAX_LANGUAGES = 200

_ADDED = ["lang_pred", "score", "rejected"]
_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    """Runs of letters in lower case, joined by spaces."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def fit_dictionaries(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     lang_column: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, from a bounded sample of the labelled rows.

    Rows with a null label, id or text are left out. The sample has ``SAMPLE_ROWS`` rows
    a language at most, whatever the size of the table.
    """
    ready(labelled.sparkSession)
    rows = labelled.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"),
                           F.xxhash64(id_column).alias("h"), F.col(id_column).alias("id"))
    rows = rows.where("lang is not null and text is not null and id is not null")
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Thin out by hash first, so what is sorted doesn't grow with the table.
    few = F.lit(False)
    for r in sizes:
        share = min(1.0, 4 * SAMPLE_ROWS / r["count"])
        few = few | ((F.col("lang") == r["lang"])
                     & (F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    start = F.pmod(F.xxhash64("id", F.lit("slice")),
                   F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))
    order = Window.partitionBy("lang").orderBy("h", "id", "slice")
    sample = (rows.where(few)
              .select("lang", "h", "id", F.substr("text", (start + 1).cast("int"),
                                                  F.lit(SAMPLE_CHARS)).alias("slice"))
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS))
    content: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"])):
        if letters := letters_of(r["slice"]):
            content.setdefault(r["lang"], []).append(letters)
    return {lang: b" ".join(parts)[:DICTIONARY_BYTES] for lang, parts in sorted(content.items())}


class Classifier:
    """Compressors for each language; made once per task."""

    def __init__(self, dictionaries: Mapping[str, bytes]):
        self._compressors = []
        for lang, content in dictionaries.items():
            dictionary = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self._compressors.append((lang, zstandard.ZstdCompressor(
                dict_data=dictionary, level=LEVEL, write_content_size=False,
                write_checksum=False, write_dict_id=False)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin; ``UNKNOWN`` and 0 for a text without a letter."""
        if not text or not any(map(str.isalpha, text)) or not self._compressors:
            return UNKNOWN, 0.0
        letters = letters_of(text)
        blocks = [letters[i:i + BLOCK_BYTES] for i in range(0, len(letters), BLOCK_BYTES)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang)
                       for lang, c in self._compressors)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if sizes[1][0] else 0.0


def _classify(batches: Iterator[pa.RecordBatch], column: str, dictionaries: Mapping[str, bytes],
              margin: float) -> Iterator[pa.RecordBatch]:
    classifier = Classifier(dictionaries)
    for batch in batches:
        found = [classifier.predict(x.as_py()) for x in batch.column(column)]
        langs = [x[0] for x in found]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(langs, pa.string()),
             pa.array([x[1] for x in found], pa.float64()),
             pa.array([x[0] == UNKNOWN or x[1] < margin for x in found], pa.bool_())],
            names=[*batch.schema.names, *_ADDED])


def identify_language(docs: DataFrame, dictionaries: Mapping[str, bytes],
                      text_column: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the margin: how much smaller the best language makes the text than the
    second best, from 0 to 1. A null text, or one without a letter, is ``UNKNOWN`` with
    score 0 and rejected; so is every text if no language was learned. With one language
    every other text is that one, with score 1. Of equal sums the first name wins. Input
    columns with the added names are replaced; an empty table gives an empty one.
    """
    docs = docs.drop(*_ADDED)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    classify = partial(_classify, column=text_column, dictionaries=dict(dictionaries),
                       margin=min_margin)
    return docs.mapInArrow(classify, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept out of training: the CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
