"""Versions of the stored market: one manifest names the files of all five tables.

Stored files are never changed. A change writes new files and then one manifest, which lists
for each table the files that count from now on. Readers follow the newest manifest, so they
see all of a change or nothing, and a job that is lost between two tables leaves the version
before it in force; what it wrote is named nowhere. The manifest holds one line per file, so
its size follows the number of files and not of rows.

Open auctions lie in folders by the hour in which they end, all others in one folder. The
manifest names folder and file, so what is due is found in the names, without opening files
of auctions that end later or have been closed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.clock import HOUR
from gavel.functions.labels import is_open
from gavel.schemas import TABLES, empty
from gavel.sources.tables import LAYOUT, Tables, _typed, _writer

#: Rows of one stored file at most.
FILE_ROWS = 2_000_000
#: Up to so many keys are looked up as literals, which Parquet's statistics and bloom
#: filters see; more of them are joined.
LITERAL_KEYS = 1_000


#: How long the span of end times is that open auctions of one folder share. It may change
#: between writes, since folders are named by its start.
SHELF_MS = HOUR
_OPEN_SHELF = re.compile(r"/shelf=open(-?\d+)/")
_SHELF = "/shelf="


class VersionTaken(RuntimeError):
    """Somebody else has committed since the version that a change started from."""


@dataclass(frozen=True)
class Version:
    """The files of each table, relative to ``path``."""

    path: str
    number: int
    files: Mapping[str, tuple[str, ...]]

    def read(self, spark: SparkSession, table: str, files: Iterable[str] | None = None) -> DataFrame:
        """The rows of one table, or of some of its files."""
        files = self.files[table] if files is None else files
        if not files:
            return empty(spark, TABLES[table])
        return spark.read.schema(TABLES[table]).parquet(*[f"{self.path}/{f}" for f in files])

    def tables(self, spark: SparkSession) -> Tables:
        return Tables(**{name: self.read(spark, name) for name in TABLES})

    def files_where(self, spark: SparkSession, table: str, condition: Column,
                    among: Iterable[str] | None = None) -> list[str]:
        """Files, of all or ``among`` some, with a row that meets ``condition``."""
        among = self.files[table] if among is None else tuple(among)
        return _files_of(self.read(spark, table, among).where(condition)) if among else []

    def files_ending_by(self, at_ms: int) -> list[str]:
        """Files that may hold an open auction which has ended by then, by their names."""
        def may_be_due(file: str) -> bool:
            shelf = _OPEN_SHELF.search(file)
            return int(shelf[1]) <= at_ms if shelf else _SHELF not in file

        return [f for f in self.files["auctions"] if may_be_due(f)]

    def files_with(self, spark: SparkSession, table: str,
                   keys: Mapping[str, DataFrame]) -> list[str]:
        """Files with a row whose column holds one of the ids (column ``id``) given for it."""
        hit: set[str] = set()
        for column, ids in keys.items():
            few = [r["id"] for r in ids.select("id").distinct().limit(LITERAL_KEYS + 1).collect()]
            if not few or not self.files[table]:
                continue
            if len(few) <= LITERAL_KEYS:
                hit.update(self.files_where(spark, table, F.col(column).isin(few)))
            else:
                found = self.read(spark, table).select(column, "_metadata").join(
                    ids.select(F.col("id").alias(column)), column, "left_semi")
                hit.update(_files_of(found))
        return sorted(hit)

    def replaced(self, table: str, gone: Iterable[str], new: Iterable[str]) -> tuple[str, ...]:
        gone = set(gone)
        return (*[f for f in self.files[table] if f not in gone], *new)


def _files_of(rows: DataFrame) -> list[str]:
    found = rows.select(F.regexp_extract("_metadata.file_path", "data/[^/]+/[^/]+/(shelf=[^/]+/)?[^/]+$", 0)
                        .alias("file")).distinct()
    return sorted(r["file"] for r in found.collect())


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_files(df: DataFrame, path: str, table: str, file_rows: int = FILE_ROWS) -> list[str]:
    """Write rows in the table's layout to files of their own; only files with rows are named."""
    spark = df.sparkSession
    folder = f"data/{table}/{uuid.uuid4().hex}"
    rows, shelf = _typed(df, table).repartitionByRange(*LAYOUT[table]), []
    if table == "auctions":
        end = F.unix_millis("end_time")
        start = (end - F.pmod(end, F.lit(SHELF_MS))).cast("string")
        shelf = ["shelf"]
        rows = rows.withColumn("shelf", F.when(
            is_open(F.col("status")), F.concat(F.lit("open"), start)).otherwise("rest"))
    laid_out = rows.sortWithinPartitions(*shelf, *LAYOUT[table])
    (_writer(laid_out, table, "parquet").partitionBy(*shelf).option("maxRecordsPerFile", file_rows)
     .save(f"{path}/{folder}"))
    return _files_of(spark.read.schema(TABLES[table]).parquet(f"{path}/{folder}"))


def latest(spark: SparkSession, path: str) -> Version:
    """The newest version; ``FileNotFoundError`` if there is none."""
    fs, at = _folder(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no version of a market below {path}")
    return version(spark, path, max(numbers))


def version(spark: SparkSession, path: str, number: int) -> Version:
    text = spark.read.text(f"{path}/versions/{number}.json", wholetext=True).first()[0]
    return Version(path, number, {t: tuple(files) for t, files in json.loads(text).items()})


def commit(spark: SparkSession, base: Version, **files: Iterable[str]) -> Version:
    """Make the version after ``base``, with other files for the tables named.

    The manifest is written under another name and renamed, so it is there whole or not at
    all. ``VersionTaken`` if there is a version after ``base`` already. Where a file system's
    rename replaces files, as a local one's does, writers have to take turns.
    """
    done = replace(base, number=base.number + 1,
                   files={**base.files, **{t: tuple(f) for t, f in files.items()}})
    fs, target = _folder(spark, f"{base.path}/versions/{done.number}.json")
    _, draft = _folder(spark, f"{base.path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps({t: list(f) for t, f in done.files.items()}).encode())
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise VersionTaken(f"version {done.number} of {base.path} is there already")
    return done


def create(tables: Tables, path: str, file_rows: int = FILE_ROWS) -> Version:
    """Store a market as version 1."""
    spark = tables.users.sparkSession
    start = Version(path, 0, {t: () for t in TABLES})
    return commit(spark, start, **{name: write_files(df, path, name, file_rows)
                                   for name, df in tables.items_by_name().items()})


def compact(spark: SparkSession, path: str, file_rows: int = FILE_ROWS) -> Version:
    """Bring all files back into the tables' layout, which changes loosen over time."""
    base = latest(spark, path)
    return commit(spark, base, **{name: write_files(df, path, name, file_rows)
                                  for name, df in base.tables(spark).items_by_name().items()})
