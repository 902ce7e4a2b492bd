"""The five stored tables and the input feeds, with explicit types.

Money is a whole number of rupees (long, never floating point) and every
timestamp is UTC with millisecond precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**fields: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(),
             "boolean": T.BooleanType(), "double": T.DoubleType()}
    return T.StructType([
        T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?"))
        for name, kind in fields.items()
    ])


USERS = _schema(id="long", first_name="string", last_name="string", email="string",
                phone="string?", role="string", created_at="timestamp")
ITEMS = _schema(id="long", seller_id="long", title="string", description="string",
                category="string", image_url="string", created_at="timestamp")
AUCTIONS = _schema(id="long", item_id="long", starting_price="long", current_price="long",
                   start_time="timestamp", end_time="timestamp", status="string",
                   winner_id="long?", created_at="timestamp")
BIDS = _schema(id="long", auction_id="long", bidder_id="long", amount="long",
               created_at="timestamp")
TRANSACTIONS = _schema(id="long", auction_id="long", buyer_id="long", seller_id="long",
                       amount="long", status="string", created_at="timestamp")

TABLES = {"users": USERS, "items": ITEMS, "auctions": AUCTIONS, "bids": BIDS,
          "transactions": TRANSACTIONS}

# Feeds: requests that have not been checked yet, so everything may be null.
BID_ATTEMPTS = _schema(id="long?", auction_id="long?", bidder_id="long?", amount="double?",
                       created_at="timestamp?")
PAYMENT_ATTEMPTS = _schema(id="long?", auction_id="long?", buyer_id="long?",
                           created_at="timestamp?")
LOGIN_ATTEMPTS = _schema(id="long?", ip="string?", email="string?", success="boolean?",
                         created_at="timestamp?")
LISTING_FEED = _schema(feed_id="long?", seller_id="long?", title="string?",
                       description="string?", category="string?", imageUrl="string?",
                       startingPrice="string?", endTime="string?")
REGISTRATION_FEED = _schema(feed_id="long?", firstName="string?", lastName="string?",
                            email="string?", phone="string?", password="string?",
                            confirmPassword="string?", seller="string?")
LOGIN_FEED = _schema(feed_id="long?", email="string?", password="string?")
SUBSCRIBE_FEED = _schema(id="long?", client_id="long?", raw="string?", ts="timestamp?")



def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows that the optimizer can recognise as empty."""
    return spark.range(1).where(F.lit(False)).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


# Value sets of the enumerated columns.
ROLES = ("buyer", "seller")
AUCTION_STATUSES = ("open", "closed", "cancelled")
PAYMENT_STATUSES = ("pending", "paid")
