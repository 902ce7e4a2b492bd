"""Ends of auctions whose late bids move the end by another time than the late window.

A bid at t is late if no more than ``window`` is left, and then sets the end to
t + ``extension``: later or earlier than it was. Each bid so is a function of the end
it finds, and which bids are late depends on all late bids before. The late bids form a
chain: after one at t, the next is the first later bid at or after t + extension - window,
if the auction is still open then. Auctions with few bids fold the functions over their
sorted bids. Those with many are never gathered: every bid gets its successor, and
composing the successor function with itself again and again (pointer jumping) marks the
bids of the chain in logarithmically many equi-joins on (auction, bid number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.ordered import history, running
from gavel.operators.throttle import FOLD_ROWS, FOLD_ROWS_CONF, reachable
from gavel.session import shared_dir

_KEY = ["auction_id"]


def _folded(bids: DataFrame, window_ms: int, extension_ms: int) -> DataFrame:
    start = F.struct(F.col("end_ms").alias("end"),
                     F.array().cast("array<struct<t:bigint,id:bigint>>").alias("late"))

    def step(state: Column, bid: Column) -> Column:
        late = (bid["t"] < state["end"]) & (state["end"] - bid["t"] <= window_ms)
        return F.struct(
            F.when(late, bid["t"] + extension_ms).otherwise(state["end"]).alias("end"),
            F.when(late, F.concat(state["late"], F.array(bid))).otherwise(state["late"]).alias("late"))

    sorted_bids = bids.groupBy("auction_id", "end_ms").agg(
        F.sort_array(F.collect_list(F.struct("t", "id"))).alias("bids"))
    return sorted_bids.select("auction_id", F.inline(F.aggregate(
        "bids", start, step, lambda state: state["late"])))


def _jumped(bids: DataFrame, window_ms: int, extension_ms: int) -> DataFrame:
    numbered = running(history(bids, _KEY, ["t", "id"]), {"n": ("sum", F.lit(1))}).df.select(
        "auction_id", "t", "id", "end_ms", F.col("n").cast("long").alias("n")).checkpoint()
    # Bids before an instant are counted on a history of the bids and these instants.
    first = numbered.where("n = 0").select(
        "auction_id", F.lit(-1).cast("long").alias("n"), (F.col("end_ms") - window_ms).alias("t"),
        F.col("end_ms").alias("until"))
    asked = numbered.select("auction_id", "n", (F.col("t") + (extension_ms - window_ms)).alias("t"),
                            (F.col("t") + extension_ms).alias("until")).unionByName(first)
    marks = asked.withColumn("kind", F.lit(0)).unionByName(numbered.select(
        "auction_id", "n", "t", F.lit(None).cast("long").alias("until"), F.lit(1).alias("kind")))
    counted = running(history(marks, _KEY, ["t", "kind", "n"]), {"before": ("sum", F.col("kind"))}).df
    after = counted.where("kind = 0").select(
        "auction_id", "n", F.greatest(F.col("before").cast("long"), F.col("n") + 1).alias("next_n"), "until")
    # A successor that finds the auction closed is none.
    onward = numbered.select("auction_id", F.col("n").alias("next_n"), F.col("t").alias("next_t"))
    jumps = (after.join(onward, ["auction_id", "next_n"]).where("next_t < until")
             .select("auction_id", "n", "next_n").checkpoint())
    chain = reachable(jumps.where("n >= 0"), jumps.where("n < 0").select(
        "auction_id", F.col("next_n").alias("n")), _KEY)
    return numbered.join(chain, ["auction_id", "n"]).select("auction_id", "t", "id")


def late_bids(bids: DataFrame, window_ms: int, extension_ms: int) -> DataFrame:
    """The bids (auction_id, t, id) that move their auction's end.

    ``bids`` (auction_id, t, id, end_ms) are those that would be accepted while their
    auction is open; ``end_ms`` is its end before all of them. No null auctions.
    """
    spark = bids.sparkSession
    shared_dir(spark)
    fold_rows = int(spark.conf.get(FOLD_ROWS_CONF, str(FOLD_ROWS)))
    bids = bids.checkpoint()
    large = (bids.groupBy("auction_id").agg(F.count(F.lit(1)).alias("_rows"))
             .where(F.col("_rows") > fold_rows).select("auction_id").checkpoint())
    if large.isEmpty():
        return _folded(bids, window_ms, extension_ms)
    return _folded(bids.join(large, _KEY, "left_anti"), window_ms, extension_ms).unionByName(
        _jumped(bids.join(large, _KEY, "left_semi"), window_ms, extension_ms))
