"""Dashboard figures of every user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.labels import is_open, is_unpaid
from gavel.functions.money import money_inr
from gavel.operators.settle import bid_counts
from gavel.sources.tables import Tables


def buyer_stats(t: Tables) -> DataFrame:
    """Active bids, leading bids and wins; what is owed is shown before what is won."""
    best = t.bids.groupBy(F.col("bidder_id").alias("userId"), "auction_id").agg(
        F.max("amount").alias("best"))
    running = t.auctions.where(is_open(F.col("status"))).select(
        F.col("id").alias("auction_id"), "current_price")
    active = best.join(running, "auction_id").groupBy("userId").agg(
        F.count(F.lit(1)).alias("activeBids"),
        F.count_if(F.col("best") == F.col("current_price")).alias("currentlyWinning"))
    won = t.auctions.where((F.col("status") == "closed") & F.col("winner_id").isNotNull()).select(
        F.col("id").alias("auction_id"), F.col("winner_id").alias("userId"))
    payments = t.transactions.select("auction_id", F.col("status").alias("payment"))
    wins = won.join(payments, "auction_id", "left").groupBy("userId").agg(
        F.count(F.lit(1)).alias("wins"), F.count_if(is_unpaid(F.col("payment"))).alias("unpaid"))
    return (t.users.select(F.col("id").alias("userId"))
            .join(active, "userId", "left").join(wins, "userId", "left")
            .fillna(0, ["activeBids", "currentlyWinning", "wins", "unpaid"])
            .select("userId", "activeBids", "currentlyWinning",
                    F.when(F.col("unpaid") > 0, "Payment Due").otherwise("Auctions Won")
                    .alias("paymentLabel"),
                    F.when(F.col("unpaid") > 0, F.col("unpaid")).otherwise(F.col("wins"))
                    .alias("paymentValue")))


def seller_stats(t: Tables) -> DataFrame:
    """Open listings, bids on all listings, and the best price of an open one."""
    counted = t.auctions.select(F.col("id").alias("auction_id"), "item_id", "status",
                                "current_price").join(bid_counts(t.bids), "auction_id", "left")
    listed = t.items.select(F.col("id").alias("item_id"), F.col("seller_id").alias("userId"))
    live = is_open(F.col("status"))
    totals = listed.join(counted, "item_id").groupBy("userId").agg(
        F.count_if(live).alias("activeListings"),
        F.sum(F.coalesce("bid_count", F.lit(0))).alias("bidsReceived"),
        F.max(F.when(live, F.col("current_price"))).alias("best"))
    return (t.users.select(F.col("id").alias("userId")).join(totals, "userId", "left")
            .fillna(0, ["activeListings", "bidsReceived", "best"])
            .select("userId", "activeListings", "bidsReceived",
                    F.when(F.col("best") > 0, money_inr(F.col("best"))).otherwise("—")
                    .alias("highestBid")))


def dashboard_role_view(t: Tables) -> DataFrame:
    """The three figures each user sees, by role: (userId, role, card, label, value)."""
    def figures(stats: DataFrame, role: str, *cards: tuple[Column, str]) -> DataFrame:
        of_role = t.users.where((F.col("role") == "seller") == (role == "seller")).select(
            F.col("id").alias("userId"), "role")
        return stats.join(of_role, "userId").select("userId", "role", F.inline(F.array(*[
            F.struct(F.lit(i).alias("card"), label.alias("label"),
                     F.col(value).cast("string").alias("value"))
            for i, (label, value) in enumerate(cards, 1)])))

    buyers = figures(buyer_stats(t), "buyer", (F.lit("Active Bids"), "activeBids"),
                     (F.lit("Currently Winning"), "currentlyWinning"),
                     (F.col("paymentLabel"), "paymentValue"))
    sellers = figures(seller_stats(t), "seller", (F.lit("Active Listings"), "activeListings"),
                      (F.lit("Bids Received"), "bidsReceived"), (F.lit("Highest Bid"), "highestBid"))
    return buyers.unionByName(sellers)
