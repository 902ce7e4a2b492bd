"""Steps that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import RUNTIME_CONF, prepare, shared_dir

# A table that a caller hands over is broadcast up to this many rows only.
BROADCAST_ROWS = 50_000


def ready(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure that checkpoints reach all executors."""
    shared_dir(prepare(spark, RUNTIME_CONF))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that start in here remove their shuffle files when they end.

    Their result lies in the shared folder, so nothing reads these files again, and they
    need not wait for the driver's garbage collection.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder so that later readers agree on them."""
    with shuffles_dropped(ready(df.sparkSession)):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of the shared folder: smaller than a checkpoint for many
    rows, and each reader takes only its columns. The folder's owner clears it."""
    spark = ready(df.sparkSession)
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows, reading no more than one above that."""
    return df.limit(rows + 1).count() <= rows


def thinned(df: DataFrame, hashed: Column, rows: int) -> DataFrame:
    """About four times ``rows`` rows by their hash, or all of a table with fewer."""
    share = min(1.0, 4 * rows / max(df.count(), 1))
    return df.where(F.pmod(hashed, F.lit(1 << 30)) <= int(share * (1 << 30)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are read.

    A generator keeps the optimizer from copying the expressions into each of their
    readers, which inside a lambda would repeat them for each array element.
    """
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline(made).alias(*columns))
