"""State and wording shown beside a bid, a listing, a win or an auction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.money import money_inr


def is_open(status: Column) -> Column:
    """Open by status alone; the end time is deliberately not looked at."""
    return status == "open"


def is_biddable(status: Column, end: Column, now: Column) -> Column:
    """Open and strictly before its end."""
    return is_open(status) & (end > now)


def is_due(status: Column, end: Column, now: Column) -> Column:
    """Open although its end has come (inclusive), so settlement must close it."""
    return is_open(status) & (end <= now)


def is_unpaid(payment_status: Column) -> Column:
    """Everything but 'paid'; a missing invoice counts as unpaid."""
    return ~payment_status.eqNullSafe(F.lit("paid"))


def min_next_bid(bid_count: Column, starting: Column, current: Column) -> Column:
    return F.when(bid_count == 0, starting).otherwise(current + 1)


def price_label(bid_count: Column, detail: bool = False) -> Column:
    return F.when(bid_count > 0, "Current Highest Bid" if detail else "Current Bid").otherwise(
        "Starting Bid")


def bid_count_label(bid_count: Column) -> Column:
    return F.concat(bid_count.cast("string"), F.when(bid_count == 1, " Bid").otherwise(" Bids"))


def bid_state(status: Column, is_winning: Column) -> Column:
    return F.when(status != "open", "Closed").when(is_winning == 1, "Winning").otherwise("Outbid")


def listing_state(status: Column, payment_status: Column, winner: Column) -> Column:
    return (F.when(status == "open", "Live").when(payment_status == "paid", "Sold · Paid")
            .when(winner.isNotNull(), "Sold · Awaiting payment").otherwise("Unsold"))


def win_state(payment_status: Column) -> Column:
    return F.when(payment_status == "paid", "Paid").otherwise("Payment due")


def bidder_label(bidder: Column, viewer: Column, masked: Column) -> Column:
    return F.when(bidder == viewer, "You").otherwise(masked)


def auction_outcome(biddable: Column, status: Column, winner: Column, winner_name: Column,
                    viewer: Column, payment_status: Column, price: Column) -> Column:
    """Result notice of an auction that takes no more bids; null while it does."""
    won = winner_name.isNotNull() & (viewer == winner)
    at = F.concat(F.lit(" at "), money_inr(price), F.lit("."))
    return F.when(
        ~biddable,
        F.when(won & (payment_status == "paid"),
               F.concat(F.lit("You won this auction"), at, F.lit(" Payment complete.")))
        .when(won, F.concat(F.lit("Congratulations - you won this auction"), at))
        .when(winner_name.isNotNull(),
              F.concat(F.lit("This auction has ended. Won by "), winner_name, at))
        .when(status == "closed", "This auction ended with no bids.")
        .otherwise("This auction has ended."))
