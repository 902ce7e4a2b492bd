"""Running values over ordered histories, also when one key holds most rows.

Bids, logins, payments and subscriptions are histories: rows of one key in
(time, id) order, where a row's result depends on the rows before it. A window
partitioned by the key does that in one shuffle, but puts a hot key into one
task. ``history`` therefore looks for hot keys and cuts only *their* rows into
ordered pieces; ``running`` then computes the window per (key, piece) and adds
what the earlier pieces of the key carry in. Sums, maxima and minima combine
across pieces exactly, so the result does not depend on where the cuts fall.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.session import shared_dir

HOT_ROWS_CONF = "spark.gavel.hotRows"
DEFAULT_HOT_ROWS = 2_000_000
PIECE = "_piece"
#: Buckets of the first count of keys, a power of two: well above rows / hot_rows, so that
#: keys which are not hot seldom make a hot bucket together.
BUCKETS = 1 << 20


@dataclass(frozen=True)
class History:
    """Rows with their key columns and ascending order columns.

    ``pieces`` is empty for an uncut history, else it names the piece column:
    0 for keys left whole, and rising with the order for the cut ones.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    pieces: tuple[str, ...] = ()

    @property
    def part(self) -> list[str]:
        return [*self.keys, *self.pieces]

    def map(self, change) -> History:
        """Apply a row-preserving change to the rows."""
        return replace(self, df=change(self.df))


def _hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and their ``_rows``, None if there are none.

    Rows are first counted by buckets of a hash, so a task keeps and sends at most
    ``BUCKETS`` numbers, however many keys there are and however wide. A hot key makes its
    bucket hot, so none is missed; only keys of hot buckets are counted themselves, which
    leaves out those that merely share a bucket. Usually no bucket is hot and that one job
    decides. There are at most rows / hot_rows hot buckets and keys, so their lists are held
    by the driver, may be broadcast, and are the same for every reader. A null key is a key
    like any other.
    """
    spark, limit = df.sparkSession, _hot_rows(df)
    rows, buckets = F.count(F.lit(1)).alias("_rows"), df.select(*keys).withColumn(
        "_bucket", F.xxhash64(*keys).bitwiseAND(F.lit(BUCKETS - 1)))
    full = [(r["_bucket"],) for r in buckets.groupBy("_bucket").agg(rows).where(
        F.col("_rows") > limit).collect()]
    if not full:
        return None
    some = buckets.join(F.broadcast(spark.createDataFrame(full, "_bucket long")), "_bucket")
    hot = some.groupBy(*keys).agg(rows).where(F.col("_rows") > limit)
    found = hot.collect()
    return spark.createDataFrame(found, hot.schema) if found else None


def _same(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join a broadcast table on keys of which any may be null."""
    named = other.select(*[F.col(c).alias(f"_same_{c}" if c in keys else c) for c in other.columns])
    on = reduce(and_, [df[k].eqNullSafe(named[f"_same_{k}"]) for k in keys])
    return df.join(F.broadcast(named), on, how).drop(*[f"_same_{k}" for k in keys])


def packed(high: Column | str, low: Column | str) -> Column:
    """One number that orders like (high, low), two longs of which the low ones, such as
    ids, have one sign. A decimal keeps all digits, and a hash aggregate can hold it."""
    high = F.col(high) if isinstance(high, str) else high
    low = F.col(low) if isinstance(low, str) else low
    return (high.cast("decimal(19,0)") * F.lit(Decimal(10**19)) + low.cast("decimal(19,0)")).cast(
        "decimal(38,0)")


def lookup(fact: DataFrame, reference: DataFrame, keys: Sequence[str], how: str = "left",
           counted: DataFrame | None = None) -> DataFrame:
    """Join a fact side with one reference row per key, whatever the skew.

    Rows of hot keys meet the reference rows of just these keys as a broadcast, so
    they are not shuffled; all others join as usual. AQE alone does not split a join
    whose other side is already partitioned by the key. ``counted`` may name a
    cheaper input with at least as many rows per key to look for hot keys in.
    """
    keys = list(keys)
    hot = hot_keys(fact if counted is None else counted, keys)
    if hot is None:
        return fact.join(reference, keys, how)
    few = hot.select(*keys)
    hot_reference = F.broadcast(_same(reference, few, keys, "left_semi"))
    rest = _same(fact, few, keys, "left_anti").join(reference, keys, how)
    return rest.unionByName(
        _same(fact, few, keys, "left_semi").join(hot_reference, keys, how))


def history(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            counted: DataFrame | None = None) -> History:
    """Prepare rows for ``running``; ``order`` must be total within a key.

    ``counted`` may name a cheaper input with at least as many rows per key to look for
    hot keys in.

    Range partitioning by (key, order) cuts the rows of hot keys at sampled
    quantiles, and the checkpoint fixes the cut: a task that is run again, or a
    second reader of the rows, sees the same pieces.
    """
    whole = History(df, tuple(keys), tuple(order))
    hot = hot_keys(df if counted is None else counted, keys)
    if hot is None:
        return whole
    total = hot.agg(F.sum("_rows")).first()[0]
    keys_only = hot.select(*keys)
    shared_dir(df.sparkSession)
    cut = (_same(df, keys_only, keys, "left_semi")
           .repartitionByRange(math.ceil(total / _hot_rows(df)) + 1, *keys, *order)
           .withColumn(PIECE, F.spark_partition_id() + 1)
           .checkpoint())
    rest = _same(df, keys_only, keys, "left_anti").withColumn(PIECE, F.lit(0))
    return replace(whole, df=rest.unionByName(cut), pieces=(PIECE,))


_AGGREGATES = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(hist: History, values: Mapping[str, tuple[str, Column]],
            inclusive: bool = False) -> History:
    """Add, per row, aggregates over the rows before it (``inclusive``: and itself).

    ``values`` maps a new column to ("sum" | "max" | "min", expression). Sums
    start at 0, the others are null until a row contributes.
    """
    frame = (Window.partitionBy(*hist.part).orderBy(*hist.order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = {}
    for name, (kind, value) in values.items():
        column = _AGGREGATES[kind][0](value).over(frame)
        local[name] = F.coalesce(column, F.lit(0)) if kind == "sum" else column
    rows = hist.df.withColumns(local)
    if not hist.pieces:
        return replace(hist, df=rows)

    # Only cut keys have pieces above 0; each piece boundary adds one row here,
    # so the carry table is bounded by the number of pieces and hot keys.
    earlier = (Window.partitionBy(*hist.keys).orderBy(PIECE)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (hist.df.where(F.col(PIECE) > 0).groupBy(*hist.part)
             .agg(*[_AGGREGATES[kind][0](value).alias(name)
                    for name, (kind, value) in values.items()])
             .select(*hist.part, *[_AGGREGATES[kind][0](name).over(earlier).alias(f"_{name}_in")
                                   for name, (kind, _) in values.items()]))
    joined = _same(rows, carry, hist.part, "left")
    combined = joined.withColumns({
        name: _AGGREGATES[kind][1](F.col(f"_{name}_in"), F.col(name))
        for name, (kind, _) in values.items()})
    return replace(hist, df=combined.drop(*[f"_{name}_in" for name in values]))


def attach(hist: History, reference: DataFrame) -> History:
    """Left-join one reference row per key to the history.

    A cut key's reference row is copied to each of its pieces, so the join and
    the windows share one partitioning by (key, piece) and no task sees a whole
    hot key.
    """
    if hist.pieces:
        cut = hist.df.where(F.col(PIECE) > 0).select(*hist.part).distinct()
        reference = reference.withColumn(PIECE, F.lit(0)).unionByName(
            cut.join(reference, list(hist.keys)))
    return hist.map(lambda df: df.join(reference, hist.part, "left"))


def place(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based place of each row in the order of the whole table; ``order`` must be total.

    The rows are dealt out by ranges of the order and fixed there by a checkpoint, then
    numbered within each range, after the rows of the ranges before it. Only one count
    per range reaches the driver.
    """
    spark = df.sparkSession
    shared_dir(spark)
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    # The id that Spark gives a row is its partition's number and its own in there.
    ranges = ranges.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = sorted(ranges.groupBy(part.alias("_part")).count().collect())
    before = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)],
                                    "_part long, _before long")
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (ranges.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + nth).drop("_part", "_before", "_at"))


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
             counted: DataFrame | None = None) -> DataFrame:
    """1-based place of each row within its key."""
    counted = running(history(df, keys, order, counted), {name: ("sum", F.lit(1))}, inclusive=True)
    return counted.df.withColumn(name, F.col(name).cast("long")).drop(*counted.pieces)
