"""Bulk registration and listing: rows to append, with the ids they get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.clock import as_of_column
from gavel.functions.text import norm_email
from gavel.operators.ordered import place
from gavel.session import shared_dir

def max_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def with_next_ids(rows: DataFrame, feed_key: str, after: int, name: str = "id") -> DataFrame:
    """Number rows ``after`` + 1, 2, … in the order of the unique ``feed_key``."""
    return place(rows, [feed_key], "_nth").withColumn(name, F.col("_nth") + after).drop("_nth")


def users_by_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Public user columns for each incoming ``email``, ignoring case and outer space."""
    asked = emails.select("*", norm_email(F.col("email")).alias("_key"))
    known = users.select(*users.columns, F.lower("email").alias("_key"))
    return known.join(asked.select(F.col("feed_id"), "_key"), "_key").drop("_key")


def taken_emails(users: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed rows whose email is registered already."""
    known = users.select(F.lower("email").alias("_key"))
    return feed.withColumn("_key", norm_email(F.col("email"))).join(
        known, "_key", "left_semi").drop("_key")


def free_emails(users: DataFrame, feed: DataFrame) -> DataFrame:
    known = users.select(F.lower("email").alias("_key"))
    return feed.withColumn("_key", norm_email(F.col("email"))).join(
        known, "_key", "left_anti").drop("_key")


def ingest_users(users: DataFrame, valid: DataFrame, as_of: Column | str) -> DataFrame:
    """New user rows: the first feed row of each email that is still free.

    A feed row that comes twice registers once; of different rows with one feed id and
    email any one does. The valid rows are stored before they are numbered, so that
    validation runs once.
    """
    columns = ["first_name", "last_name", "phone", "role"]
    shared_dir(users.sparkSession)
    rows = valid.select("feed_id", "email", *columns).checkpoint()
    # The least feed id takes a hash aggregate; its row is then looked up.
    least = rows.groupBy("email").agg(F.min("feed_id").alias("feed_id"))
    first = rows.join(least, ["feed_id", "email"], "left_semi").dropDuplicates(["email"])
    numbered = with_next_ids(free_emails(users, first).checkpoint(), "feed_id", max_id(users))
    return numbered.select("id", "first_name", "last_name", "email", "phone", "role",
                           as_of_column(as_of).alias("created_at"))


def ingest_listings(items: DataFrame, auctions: DataFrame, valid: DataFrame,
                    as_of: Column | str) -> tuple[DataFrame, DataFrame]:
    """(new items, new auctions), one of each per listing.

    Both ids follow from the feed id alone, so either half can be computed again
    on its own and still matches the other.
    """
    now = as_of_column(as_of)
    first_item, first_auction = max_id(items), max_id(auctions)
    rows = with_next_ids(valid, "feed_id", 0, "nth").withColumn("created_at", now)
    item_id = F.col("nth") + first_item
    new_items = rows.select(item_id.alias("id"), "seller_id", "title", "description", "category",
                            "image_url", "created_at")
    new_auctions = rows.select(
        (F.col("nth") + first_auction).alias("id"), item_id.alias("item_id"), "starting_price",
        F.col("starting_price").alias("current_price"), F.col("created_at").alias("start_time"),
        "end_time", F.lit("open").alias("status"), F.lit(None).cast("long").alias("winner_id"),
        "created_at")
    return new_items, new_auctions
