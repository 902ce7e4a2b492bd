"""Synthetic bid ladders for demo and load data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.clock import MINUTE, as_of_column
from gavel.operators.ordered import place

BID_INTERVAL_MS = 7 * MINUTE


#: Steps of a ladder that one row is spread into at once.
BLOCK = 10_000


def seed_bid_ladder(auctions: DataFrame, buyers: DataFrame, now: Column | str) -> DataFrame:
    """Bids (auction_id, step, bidder_id, amount, created_at) for auctions with
    ``starting_price``, ``current_price`` and ``bid_count``.

    Amounts rise evenly and end at the current price, bids are seven minutes apart, the
    last seven minutes before ``now``. The ``buyers`` (id) take turns in order of id.
    """
    turns = place(buyers.select(F.col("id").alias("bidder_id")), ["bidder_id"], "_turn")
    n_buyers = buyers.count()
    count, step = F.col("bid_count"), F.col("step")
    spread = F.col("current_price") - F.col("starting_price")
    # Rounded half up in whole numbers: floor((2ab + c) / 2c).
    doubled = F.col("spread2") * (step + 1) + count
    rise = (doubled - F.pmod(doubled, count * 2)) / (count * 2)

    def numbers(first: Column, last: Column) -> Column:
        return F.explode(F.when(last >= first, F.sequence(first, last)))

    zero = F.lit(0).cast("long")
    # In blocks, so that no row holds a whole ladder.
    steps = (auctions.select(F.col("id").alias("auction_id"), "starting_price", "bid_count",
                             (spread * 2).alias("spread2"))
             .withColumn("_block", numbers(zero, F.floor((count - 1) / BLOCK)))
             .withColumn("step", numbers(F.col("_block") * BLOCK, F.least(
                 count - 1, F.col("_block") * BLOCK + (BLOCK - 1))))
             .withColumn("_turn", F.pmod(step, F.lit(max(n_buyers, 1))) + 1))
    return steps.join(turns, "_turn").select(
        "auction_id", "step", "bidder_id",
        (F.col("starting_price") + rise.cast("long")).alias("amount"),
        F.timestamp_millis(F.unix_millis(as_of_column(now))
                           - (count - step) * BID_INTERVAL_MS).alias("created_at"))
