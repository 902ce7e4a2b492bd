"""A marketplace derived from the star-schema and event tables.

Every part becomes an item, nearly every part an auction, every customer a user,
and the events become bid, login and subscription requests. A third of the
requests goes to twenty hot auctions. All derivations are plain column
expressions, so the feeds grow with the tables they come from.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.schemas import BIDS, TRANSACTIONS, empty
from gavel.sources.tables import Tables
from gavel.streaming.runtime import read_stream

AS_OF = "2024-01-20T00:00:00+00:00"
SELLERS = 15
HOT_AUCTIONS = 20


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# The source columns used here; nothing is inferred from the files.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_acctbal double, c_mktsegment string",
    "part": """p_partkey long, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _rows(app: str, spark: SparkSession, sf_dir: str, name: str) -> int:
    return _read(spark, sf_dir, name).count()


def part_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of items; answered from the file footers, once per session."""
    return _rows(spark.sparkContext.applicationId, spark, sf_dir, "part")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        (key + 1).alias("id"),
        F.col("c_mktsegment").alias("first_name"),
        key.cast("string").alias("last_name"),
        F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com")).alias("email"),
        F.when(key % 7 != 0, F.concat(F.lit("+91 9"), F.lpad(key.cast("string"), 9, "0")))
        .alias("phone"),
        F.when(key % 10 == 0, "seller").otherwise("buyer").alias("role"),
        _ts("2023-12-01 00:00:00").alias("created_at"))


def users_in_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the users to erase in the erasure check."""
    return _read(spark, sf_dir, "customer").where("c_acctbal < 0").select(
        (F.col("c_custkey") + 1).alias("id"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        (key + 1).alias("id"),
        ((key % SELLERS) * 10 + 1).alias("seller_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("description"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("https://img.example.com/"), key.cast("string"), F.lit(".jpg"))
        .alias("image_url"),
        _ts("2024-01-01 00:00:00").alias("created_at"))


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One auction per part, none for size 50 (not yet listed), and a second,
    later one for size 1 (relisted)."""
    key, price = F.col("p_partkey"), F.floor("p_retailprice").cast("long") - 890
    parts = _read(spark, sf_dir, "part")

    def listed(df: DataFrame, auction_id: Column, start: str, first_end: str, days: int,
               status: Column) -> DataFrame:
        return df.select(
            auction_id.alias("id"), (key + 1).alias("item_id"),
            price.alias("starting_price"), price.alias("current_price"),
            _ts(start).alias("start_time"),
            (F.timestamp_millis(F.unix_millis(_ts(first_end)) + (key % days) * 86_400_000))
            .alias("end_time"),
            status.alias("status"), F.lit(None).cast("long").alias("winner_id"),
            _ts(start).alias("created_at"))

    first = listed(parts.where("p_size <> 50"), key + 1, "2024-01-01 00:00:00",
                   "2024-01-05 00:00:00", 25,
                   F.when(key % 17 == 0, "cancelled").otherwise("open"))
    again = listed(parts.where("p_size = 1"), key + 1 + part_count(spark, sf_dir),
                   "2024-01-15 00:00:00", "2024-01-30 00:00:00", 5, F.lit("open"))
    return first.unionByName(again)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream."""
    return read_stream(spark, f"{sf_dir}/events.parquet*", SCHEMAS["events"])


def _events(spark: SparkSession, sf_dir: str, events: DataFrame | None, *types: str) -> DataFrame:
    """Events of the given types with millisecond timestamps."""
    events = _read(spark, sf_dir, "events") if events is None else events
    return (events.where(F.col("event_type").isin(*types))
            .withColumn("created_at", F.date_trunc("millisecond", F.col("ts").cast("timestamp"))))


def _target_auction(spark: SparkSession, sf_dir: str) -> Column:
    n = part_count(spark, sf_dir)
    event = F.col("event_id")
    return F.when(event % 3 == 0, F.floor(event / 3) % HOT_AUCTIONS).otherwise(
        event % (n + n // 10)).cast("long") + 1


def bid_attempts(spark: SparkSession, sf_dir: str,
                 events: DataFrame | None = None) -> DataFrame:
    return _events(spark, sf_dir, events, "click", "view", "purchase").select(
        (F.col("event_id") + 1).alias("id"),
        _target_auction(spark, sf_dir).alias("auction_id"),
        (F.col("user_id") + 1).alias("bidder_id"),
        F.floor("value").cast("long").alias("amount"), "created_at")


def login_attempts(spark: SparkSession, sf_dir: str,
                   events: DataFrame | None = None) -> DataFrame:
    user = F.col("user_id")
    return _events(spark, sf_dir, events, "error", "signup").select(
        (F.col("event_id") + 1).alias("id"),
        F.concat(F.lit("10.0.0."), (user % 250).cast("string")).alias("ip"),
        F.concat(F.lit("user"), user.cast("string"), F.lit("@example.com")).alias("email"),
        (F.col("event_type") == "signup").alias("success"), "created_at")


def subscribe_feed(spark: SparkSession, sf_dir: str,
                   events: DataFrame | None = None) -> DataFrame:
    """Socket messages: views watch one auction, clicks the whole market, and
    the rest is text, numbers in text and other messages."""
    target = _target_auction(spark, sf_dir).cast("string")

    def message(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value, F.lit(after))

    kind = F.col("event_type")
    raw = (F.when(kind == "view", message('{"type": "subscribe", "auctionId": ', target, "}"))
           .when(kind == "purchase", message('{"type": "subscribe", "auctionId": "', target, '"}'))
           .when(kind == "click", '{"type": "subscribe", "auctionId": "all"}')
           .when(kind == "signup", '{"type": "ping"}').otherwise("not json"))
    return _events(spark, sf_dir, events, "view", "purchase", "click", "signup", "error").select(
        (F.col("event_id") + 1).alias("id"), (F.col("user_id") + 1).alias("client_id"),
        raw.alias("raw"), F.col("created_at").alias("ts"))


def payment_attempts(auctions: DataFrame) -> DataFrame:
    """Two payments per auction, an hour after settlement and a minute apart: the
    first by somebody else for every third auction, the others by the winner."""
    due = F.unix_millis(_ts("2024-01-20 01:00:00"))
    winner = F.coalesce("winner_id", F.lit(1))
    stranger = F.col("id") % 150 + 1
    return auctions.select(
        F.col("id").alias("auction_id"),
        F.explode(F.array(
            F.struct((F.col("id") * 2).alias("id"),
                     F.when(F.col("id") % 3 == 1, stranger).otherwise(winner).alias("buyer_id"),
                     F.timestamp_millis(due).alias("created_at")),
            F.struct((F.col("id") * 2 + 1).alias("id"), winner.alias("buyer_id"),
                     F.timestamp_millis(due + 60_000).alias("created_at")))).alias("p"),
    ).select("p.id", "auction_id", "p.buyer_id", "p.created_at")


def listing_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing form per part, with the mistakes people make."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return _read(spark, sf_dir, "part").select(
        (key + 1).alias("feed_id"),
        ((key % SELLERS) * 10 + 1).alias("seller_id"),
        F.when(size % 11 == 0, "   ").when(size % 11 == 1, F.repeat("p_name", 30))
        .otherwise(F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" "))).alias("title"),
        F.when(size % 13 == 0, "").when(size % 13 == 1, F.repeat(F.lit("long text "), 101))
        .otherwise(F.col("p_brand")).alias("description"),
        F.when(size % 5 == 0, F.col("p_type")).when(size % 5 == 1, "Diamonds")
        .when(size % 5 == 2, " Luxury Watches ").otherwise("Women's Jewelry").alias("category"),
        F.when(size % 7 == 0, "javascript:alert(1)").when(size % 7 == 1, "/images/photo.jpg")
        .when(size % 7 == 2, "")
        .otherwise(F.concat(F.lit("HTTPS://img.example.com/"), key.cast("string")))
        .alias("imageUrl"),
        F.when(key % 10 == 0, "").when(key % 10 == 1, "12.5").when(key % 10 == 2, "abc")
        .when(key % 10 == 3, "1e3").when(key % 10 == 4, "200000000").when(key % 10 == 5, "0x10")
        .otherwise(F.concat(F.lit(" "), size.cast("string"), F.lit("00 "))).alias("startingPrice"),
        F.when(key % 8 == 0, "tomorrow").when(key % 8 == 1, "2024-01-20T00:04:59.999Z")
        .when(key % 8 == 2, "2024-01-20T00:05:00Z").when(key % 8 == 3, "2024-02-19T00:00:00.000Z")
        .when(key % 8 == 4, "2024-02-19T00:00:00.001Z").when(key % 8 == 5, "2024-01-25T10:00+05:30")
        .when(key % 8 == 6, F.lit(None).cast("string")).otherwise("2024-01-22T12:30:00.5Z")
        .alias("endTime"))


def stream_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table as a stream."""
    return read_stream(spark, f"{sf_dir}/customer.parquet*", SCHEMAS["customer"])


def registration_feed(spark: SparkSession, sf_dir: str,
                      customers: DataFrame | None = None) -> DataFrame:
    """One registration form per customer; some addresses are taken or repeated."""
    key = F.col("c_custkey")
    text = key.cast("string")
    customers = _read(spark, sf_dir, "customer") if customers is None else customers
    return customers.select(
        (key + 1).alias("feed_id"),
        F.when(key % 11 == 0, " ").when(key % 11 == 1, F.repeat(F.lit("N"), 101))
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("firstName"),
        F.when(key % 12 == 0, F.lit(None).cast("string")).otherwise(text).alias("lastName"),
        F.when(key % 5 == 0, F.concat(F.replace("c_name", F.lit("#"), F.lit(".")),
                                      F.lit("@EXAMPLE.com ")))
        .when(key % 5 == 1, F.concat(F.lit("new"), F.floor(key / 10).cast("string"),
                                     F.lit("@Example.org")))
        .when(key % 5 == 2, F.concat(F.lit("new"), text, F.lit("@example")))
        .otherwise(F.concat(F.lit("new"), text, F.lit("@example.net"))).alias("email"),
        F.when(key % 13 == 0, "").otherwise(F.concat(F.lit("+91 8"), text)).alias("phone"),
        F.when(key % 9 == 0, "short").otherwise(F.concat(F.lit("secret-"), text, F.lit("-x")))
        .alias("password"),
        F.when(key % 9 == 0, "short").when(key % 9 == 1, "different")
        .otherwise(F.concat(F.lit("secret-"), text, F.lit("-x"))).alias("confirmPassword"),
        F.when(key % 4 == 0, "on").when(key % 4 == 1, "").alias("seller"))


def login_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        (key + 1).alias("feed_id"),
        F.when(key % 6 == 0, " \t ").otherwise(F.concat(F.lit(" User"), key.cast("string"),
                                                       F.lit("@Example.COM"))).alias("email"),
        F.when(key % 7 == 0, "").when(key % 7 == 1, F.lit(None).cast("string"))
        .otherwise(" pw ").alias("password"))


def base_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The market before any request: no bids, no invoices."""
    return Tables(users(spark, sf_dir), items(spark, sf_dir), auctions(spark, sf_dir),
                  empty(spark, BIDS), empty(spark, TRANSACTIONS))
