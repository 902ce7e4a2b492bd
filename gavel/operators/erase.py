"""Erasing users with everything that depends on them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.sources.tables import Tables


def _without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*df.columns)


def _only(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(F.col("id").alias(column)), column, "left_semi").select(*df.columns)


def erase_cascade(t: Tables, user_ids: DataFrame) -> Tables:
    """Tables after deleting the users in ``user_ids`` (column ``id``).

    Their items go with them, those items' auctions, and all bids and invoices of
    these auctions or of these users. An auction they won elsewhere stays, without
    a winner.
    """
    users = user_ids.select("id")
    items = _only(t.items, "seller_id", users).select("id")
    auctions = _only(t.auctions, "item_id", items).select("id")
    # Only auctions with a winner are looked up by it; all others meet just their own mark.
    unwon = _only(t.auctions.where(F.col("winner_id").isNotNull()), "winner_id", users)
    marks = auctions.withColumn("_erased", F.lit(True)).unionByName(
        unwon.select("id", F.lit(False).alias("_erased"))).groupBy("id").agg(
        F.max("_erased").alias("_erased"))
    kept = (t.auctions.join(marks, "id", "left")
            .where(~F.coalesce("_erased", F.lit(False)))
            .withColumn("winner_id", F.when(F.col("_erased").isNull(), F.col("winner_id"))))
    return replace(
        t,
        users=_without(t.users, "id", users),
        items=_without(t.items, "seller_id", users),
        auctions=kept.select(*t.auctions.columns),
        bids=_without(_without(t.bids, "auction_id", auctions), "bidder_id", users),
        transactions=_without(_without(_without(
            t.transactions, "auction_id", auctions), "buyer_id", users), "seller_id", users))
