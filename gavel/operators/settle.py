"""Settlement: close due auctions, name the winner, write the invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.clock import as_of_column
from gavel.functions.labels import is_due
from gavel.operators.ordered import packed, place


def bid_counts(bids: DataFrame) -> DataFrame:
    """(auction_id, bid_count) of auctions that have bids."""
    return bids.groupBy("auction_id").agg(F.count(F.lit(1)).alias("bid_count"))


def winning_bids(bids: DataFrame) -> DataFrame:
    """Top bid per auction: highest amount, the lowest id among equals.

    Amount and id make one number, so that the maximum is a hash aggregate.
    """
    rank = packed("amount", -F.col("id"))
    return bids.withColumn("_rank", rank).groupBy("auction_id").agg(
        F.max_by("id", "_rank").alias("bid_id"), F.max_by("bidder_id", "_rank").alias("bidder_id"),
        F.max("amount").alias("amount"), F.max_by("created_at", "_rank").alias("created_at"))


def _sellers(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("item_id"), "seller_id")


def sale_details(auctions: DataFrame, items: DataFrame) -> DataFrame:
    """What a sale of each auction would be worth, and to whom."""
    return auctions.join(_sellers(items), "item_id").select(
        F.col("id").alias("auction_id"), "seller_id", F.col("current_price").alias("amount"))


def due_auctions(auctions: DataFrame, as_of: Column | str) -> DataFrame:
    return auctions.where(is_due(F.col("status"), F.col("end_time"), as_of_column(as_of)))


def due_in_order(auctions: DataFrame, as_of: Column | str) -> DataFrame:
    """(id, end_time, position) of the due auctions, the first to end first."""
    return place(due_auctions(auctions, as_of).select("id", "end_time"), ["end_time", "id"])


def insert_or_ignore(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Invoices to append: an auction that already has one keeps it.

    Several incoming rows for one auction leave one of those with the lowest id, nulls
    last. Rows without an auction are left out.
    """
    lowest = Window.partitionBy("auction_id").orderBy(F.asc_nulls_last("id"))
    first = (incoming.where(F.col("auction_id").isNotNull())
             .withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") == 1))
    return first.join(existing.select("auction_id"), "auction_id", "left_anti").select(
        *incoming.columns)


def settle_auctions(auctions: DataFrame, items: DataFrame, bids: DataFrame,
                    transactions: DataFrame, as_of: Column | str
                    ) -> tuple[DataFrame, DataFrame]:
    """(auctions after closing, new pending transactions).

    One winner per auction makes the auction id a natural invoice id: it is
    unique, and running the job again yields the same rows.
    """
    now = as_of_column(as_of)
    due = is_due(F.col("status"), F.col("end_time"), now)
    winners = winning_bids(bids).select(
        F.col("auction_id").alias("id"), F.col("bidder_id").alias("_winner"))
    settled = (
        auctions.withColumn("_due", due).join(winners, "id", "left")
        .withColumn("status", F.when(F.col("_due"), "closed").otherwise(F.col("status")))
        .withColumn("winner_id", F.when(F.col("_due"), F.col("_winner"))
                    .otherwise(F.col("winner_id"))))
    sold = settled.where(F.col("_due") & F.col("_winner").isNotNull())
    invoices = sold.join(_sellers(items), "item_id").select(
        "id", F.col("id").alias("auction_id"), F.col("_winner").alias("buyer_id"), "seller_id",
        F.col("current_price").alias("amount"), F.lit("pending").alias("status"),
        now.alias("created_at"))
    return settled.select(*auctions.columns), insert_or_ignore(transactions, invoices)
