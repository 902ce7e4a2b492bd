"""Checkout replay: the outcome of every payment attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators.ordered import lookup, packed

# Messages of the refusals.
CHECKOUT_ERRORS = {
    "NOT_FOUND": "No payment is due for that auction.",
    "NOT_WINNER": "Only the winning bidder can complete this payment.",
    "ALREADY_PAID": "This payment has already been completed.",
}


def first_payments(transactions: DataFrame, attempts: DataFrame) -> DataFrame:
    """(auction_id, paid_at, paid_by): the attempt that settles each pending invoice."""
    payable = transactions.where(F.col("status") == "pending").select(
        "auction_id", "buyer_id", F.col("created_at").alias("_due_from"))
    tried = attempts.select("id", "auction_id", "buyer_id", "created_at")
    return (lookup(tried, payable, ["auction_id", "buyer_id"], "inner")
            .where(F.col("created_at") >= F.col("_due_from"))
            .withColumn("_rank", packed(F.unix_micros("created_at"), "id"))
            .groupBy("auction_id")
            .agg(F.min("created_at").alias("paid_at"), F.min_by("id", "_rank").alias("paid_by")))


def replay_checkout(transactions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts with ``outcome``; an invoice exists from its ``created_at`` on.

    Only the winner's first attempt pays, so the state of an invoice is one
    minimum per auction, combined before the shuffle and looked up by the attempts.
    """
    attempts = attempts.select("id", "auction_id", "buyer_id", "created_at")
    named = attempts.where(F.col("auction_id").isNotNull())
    invoices = transactions.select(
        "auction_id", F.col("buyer_id").alias("_winner"), F.col("created_at").alias("_due_from"),
        (F.col("status") == "paid").alias("_was_paid")).join(
        first_payments(transactions, named).select("auction_id", "paid_by"), "auction_id", "left")
    missing = F.col("_winner").isNull() | (F.col("created_at") < F.col("_due_from"))
    judged = lookup(named, invoices, ["auction_id"]).select(
        *attempts.columns,
        F.when(missing, "NOT_FOUND")
        .when(~F.col("buyer_id").eqNullSafe(F.col("_winner")), "NOT_WINNER")
        .when(F.col("_was_paid") | (F.col("id") != F.col("paid_by")), "ALREADY_PAID")
        .otherwise("PAID").alias("outcome"))
    return judged.unionByName(attempts.where(F.col("auction_id").isNull()).withColumn(
        "outcome", F.lit("NOT_FOUND")))


def apply_payments(transactions: DataFrame, replayed: DataFrame) -> DataFrame:
    """Transactions with the paid ones marked."""
    paid = replayed.where(F.col("outcome") == "PAID").select("auction_id", F.lit(True).alias("_paid"))
    return (transactions.join(paid, "auction_id", "left")
            .withColumn("status", F.when(F.col("_paid"), "paid").otherwise(F.col("status")))
            .select(*transactions.columns))
