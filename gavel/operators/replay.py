"""Bid replay: the outcome of every bid attempt, in (time, id) order per auction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import is_long
from gavel.operators.antisnipe import late_bids
from gavel.operators.ordered import attach, history, running
from gavel.session import shared_dir

ANTI_SNIPE_MS = 2 * 60 * 1000

# Messages of the refusals.
BID_ERRORS = {
    "NOT_FOUND": "That auction does not exist.",
    "CLOSED": "This auction has already ended.",
    "OWN_ITEM": "You cannot bid on your own item.",
    "INVALID_AMOUNT": "Enter a valid bid amount in rupees.",
    "TOO_LOW": "Your bid must be higher than the current bid.",
    "BELOW_START": "Your bid must be at least the starting price.",
}


def with_message(judged: DataFrame, messages: dict[str, str] = BID_ERRORS) -> DataFrame:
    """Add the ``message`` of each refusal, null for what was accepted."""
    text = F.lit(None).cast("string")
    for outcome, message in messages.items():
        text = F.when(F.col("outcome") == outcome, message).otherwise(text)
    return judged.withColumn("message", text)


def refused_at_once() -> Column:
    """Outcome of an attempt that no auction needs to be looked at for, else null.

    An amount must be a positive whole number that a long can hold; an attempt
    without an auction is NOT_FOUND, one without a bidder or a time INVALID_ATTEMPT.
    """
    amount = F.col("amount").cast("double")
    return (F.when(F.col("auction_id").isNull(), "NOT_FOUND")
            .when(~F.coalesce(is_long(amount) & (amount > 0), F.lit(False)), "INVALID_AMOUNT")
            .when(F.col("bidder_id").isNull() | F.col("created_at").isNull(), "INVALID_ATTEMPT"))


def replay_bids(auctions: DataFrame, items: DataFrame, attempts: DataFrame,
                window_ms: int = ANTI_SNIPE_MS, extension_ms: int | None = None) -> DataFrame:
    """Attempts with ``outcome``, ``price_after``, ``end_after`` and ``extended``.

    ``auctions`` may carry a ``bid_count`` of bids accepted earlier; the current
    price then has to be beaten. A late bid moves the end to bid time +
    ``extension_ms`` (as long as the window if not given) when no more than
    ``window_ms`` is left.

    Until the auction closes, every eligible bid above all eligible bids before
    it is accepted, so one running maximum of (amount, earliest time) gives the
    current price; from the first attempt at or after the current end on,
    everything is CLOSED. If extension and window are equal, the end after an
    accepted bid at t is greatest(end, t + window) and follows from the same
    maximum. If not, ``antisnipe.late_bids`` says which bids move it.
    Attempts that ``refused_at_once`` refuses have no effect on others.
    """
    attempts = attempts.select("id", "auction_id", "bidder_id", "amount", "created_at")
    refusal = refused_at_once()

    # Refused without looking at the auction, so these rows skip the shuffle.
    stateless = attempts.where(refusal.isNotNull()).select(
        "*", refusal.alias("outcome"),
        F.lit(None).cast("long").alias("price_after"),
        F.lit(None).cast("timestamp").alias("end_after"),
        F.lit(False).alias("extended"))

    earlier_bids = F.col("bid_count") if "bid_count" in auctions.columns else F.lit(0)
    reference = (
        auctions.withColumn("bid_count", earlier_bids)
        .join(items.select(F.col("id").alias("item_id"), "seller_id"), "item_id")
        .select(
            F.col("id").alias("auction_id"), "seller_id",
            F.lit(True).alias("found"),
            (F.col("status") == "open").alias("is_open"),
            F.unix_millis("end_time").alias("end_ms"),
            (F.col("bid_count") == 0).alias("unbid"),
            F.when(F.col("bid_count") == 0, F.col("starting_price"))
            .otherwise(F.col("current_price") + 1).alias("floor_price")))

    rows = (attempts.where(refusal.isNull())
            .withColumn("rupees", F.col("amount").try_cast("long"))
            .withColumn("t", F.unix_millis("created_at")))
    hist = attach(history(rows, ["auction_id"], ["t", "id"], attempts.select("auction_id")),
                  reference)

    eligible = ((F.col("rupees") >= F.col("floor_price"))
                & (F.col("bidder_id") != F.col("seller_id")))
    hist = running(hist, {"top": ("max", F.when(
        eligible, F.struct(F.col("rupees").alias("price"), (-F.col("t")).alias("minus_t"))))})
    if extension_ms in (None, window_ms):
        extension_ms = window_ms
        hist = hist.map(lambda df: df.withColumn(
            "end_now", F.greatest("end_ms", F.lit(window_ms) - F.col("top.minus_t"))))
    else:
        shared_dir(attempts.sparkSession)
        hist = hist.map(lambda df: df.checkpoint())
        rising = eligible & F.col("is_open") & (F.col("top").isNull() | (F.col("rupees") > F.col("top.price")))
        late = late_bids(hist.df.where(rising).select("auction_id", "t", "id", "end_ms"),
                         window_ms, extension_ms)
        late = late.select("auction_id", "id", (F.col("t") + extension_ms).alias("moved_to"))
        hist = hist.map(lambda df: df.join(late, ["auction_id", "id"], "left"))
        hist = running(hist, {"moved": ("max", F.when(
            F.col("moved_to").isNotNull(), F.struct("t", "id", "moved_to")))})
        hist = hist.map(lambda df: df.withColumn("end_now", F.coalesce("moved.moved_to", "end_ms")))
    over = ~F.col("is_open") | (F.col("t") >= F.col("end_now"))
    hist = running(hist, {"closed": ("max", over)}, inclusive=True)

    taken = F.col("outcome") == "ACCEPTED"
    late_bid = F.col("end_now") - F.col("t") <= window_ms
    judged = hist.df.withColumn(
        "outcome",
        F.when(F.col("found").isNull(), "NOT_FOUND")
        .when(F.col("closed"), "CLOSED")
        .when(F.col("bidder_id") == F.col("seller_id"), "OWN_ITEM")
        .when(F.col("top").isNull() & (F.col("rupees") < F.col("floor_price")),
              F.when(F.col("unbid"), "BELOW_START").otherwise("TOO_LOW"))
        .when(F.col("rupees") <= F.col("top.price"), "TOO_LOW")
        .otherwise("ACCEPTED"),
    ).select(
        "id", "auction_id", "bidder_id", "amount", "created_at", "outcome",
        F.when(taken, F.col("rupees")).alias("price_after"),
        F.when(taken, F.timestamp_millis(F.when(late_bid, F.col("t") + extension_ms).otherwise(
            F.col("end_now")))).alias("end_after"),
        (taken & late_bid).alias("extended"))
    return judged.unionByName(stateless)


def accepted(replayed: DataFrame) -> DataFrame:
    """Accepted attempts as ``bids`` rows, with the auction end each one left."""
    return replayed.where(F.col("outcome") == "ACCEPTED").select(
        "id", "auction_id", "bidder_id", F.col("price_after").alias("amount"), "created_at",
        "end_after")


def apply_bids(auctions: DataFrame, taken: DataFrame) -> DataFrame:
    """Auctions with the price and end that accepted bids leave behind.

    Bids only raise the price, so the highest one is the last and left the end; both are
    maxima, combined before the shuffle.
    """
    latest = taken.groupBy("auction_id").agg(
        F.max("amount").alias("_price"), F.max_by("end_after", "amount").alias("_end"))
    return (auctions.join(latest, auctions["id"] == latest["auction_id"], "left")
            .withColumn("current_price", F.coalesce("_price", "current_price"))
            .withColumn("end_time", F.coalesce("_end", "end_time"))
            .select(*auctions.columns))
