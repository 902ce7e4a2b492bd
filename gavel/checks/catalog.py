"""Every operator as a query over the given tables, for checking and timing.

The read views take a market that has already been replayed and settled, as a
deployment would store it; that snapshot is derived once per session and data
folder, written to the shared folder, and read by every view.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import clock, labels, money, text
from gavel.operators import (checkout, erase, ingest, integrity, ladder, replay, rooms, settle,
                             throttle, validate)
from gavel.plans import dashboard, stored, views
from gavel.plans.snapshot import market_snapshot, replay_market
from gavel.session import prepare, shared_dir
from gavel.sources import marketplace as source
from gavel.sources import versions
from gavel.sources.sinks import json_documents
from gavel.sources.tables import Tables, append_rows, scan_table, scan_tables, write_tables
from gavel.streaming import bids as live_bids
from gavel.streaming import registrations as live_registrations
from gavel.streaming import rooms as live_rooms
from gavel.streaming import throttle as live_throttle
from gavel.streaming.runtime import read_stream, run_batches, run_to_folder, run_to_table, run_updates

AS_OF = source.AS_OF
SIX_HOURS = 6 * clock.HOUR
THREE_DAYS = 3 * clock.DAY
SESSION_GAP_MS = 6 * clock.HOUR
#: Whom the views for one request are asked for.
ONE_AUCTION, ONE_SELLER, ONE_BUYER = 2, 11, 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_derived: dict[tuple, object] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def _once(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _derived:
        _derived[key] = build()
    return _derived[key]


def _replayed(spark: SparkSession, sf_dir: str, window_ms: int = replay.ANTI_SNIPE_MS) -> DataFrame:
    return replay.replay_bids(source.auctions(spark, sf_dir), source.items(spark, sf_dir),
                              source.bid_attempts(spark, sf_dir), window_ms)


def _replayed_market(spark: SparkSession, sf_dir: str) -> Tables:
    heard = source.bid_attempts(spark, sf_dir).where(
        F.col("created_at") <= clock.as_of_column(AS_OF))
    return replay_market(source.base_tables(spark, sf_dir), heard)


def _snapshot(spark: SparkSession, sf_dir: str) -> Tables:
    return market_snapshot(source.base_tables(spark, sf_dir), source.bid_attempts(spark, sf_dir),
                           AS_OF)


def market(spark: SparkSession, sf_dir: str) -> Tables:
    """The stored market after replay and settlement."""
    def build() -> Tables:
        path = f"{shared_dir(spark)}/market-{uuid.uuid4().hex}"
        return scan_tables(spark, write_tables(_snapshot(spark, sf_dir), path))

    return _once(spark, "market", sf_dir, build)


def market_with_payments(spark: SparkSession, sf_dir: str) -> Tables:
    """The stored market after its payment attempts."""
    t = market(spark, sf_dir)

    def build() -> Tables:
        paid = checkout.replay_checkout(t.transactions, source.payment_attempts(t.auctions))
        path = f"{shared_dir(spark)}/paid-{uuid.uuid4().hex}"
        append_rows(checkout.apply_payments(t.transactions, paid), path, "transactions")
        return replace(t, transactions=scan_table(spark, path, "transactions"))

    return _once(spark, "paid market", sf_dir, build)


def _iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: clock.iso_utc(F.col(c)) for c in columns})


def _joined(errors: str = "errors") -> Column:
    return F.array_join(errors, " | ").alias("errors")


# Sources and sinks


@query
def scan_tables_profile(spark, sf_dir):
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                    F.sum("id").alias("id_sum"))
             for name, df in market(spark, sf_dir).items_by_name().items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4]).select(
        "table_name", "n_rows", "id_sum")


@query
def public_users(spark, sf_dir):
    return views.public_users(source.base_tables(spark, sf_dir))


@query
def user_by_email(spark, sf_dir):
    found = ingest.users_by_email(source.users(spark, sf_dir),
                                  source.registration_feed(spark, sf_dir))
    return found.select("feed_id", "id", "first_name", "last_name", "email", "role")


@query
def email_exists(spark, sf_dir):
    users, feed = source.users(spark, sf_dir), source.registration_feed(spark, sf_dir)
    taken = ingest.taken_emails(users, feed).select("feed_id", F.lit(True).alias("taken"))
    return taken.unionByName(ingest.free_emails(users, feed).select(
        "feed_id", F.lit(False).alias("taken")))


@query
def ingest_users(spark, sf_dir):
    valid, _ = validate.validate_registrations(source.registration_feed(spark, sf_dir))
    return _iso(ingest.ingest_users(source.users(spark, sf_dir), valid, AS_OF), "created_at")


def _new_listings(spark, sf_dir):
    valid, _ = validate.validate_listings(source.listing_feed(spark, sf_dir), AS_OF)
    return ingest.ingest_listings(source.items(spark, sf_dir), source.auctions(spark, sf_dir),
                                  valid, AS_OF)


@query
def ingest_listings_items(spark, sf_dir):
    return _iso(_new_listings(spark, sf_dir)[0], "created_at")


@query
def ingest_listings_auctions(spark, sf_dir):
    return _iso(_new_listings(spark, sf_dir)[1], "start_time", "end_time", "created_at")


@query
def ingest_bids(spark, sf_dir):
    return _iso(replay.accepted(_replayed(spark, sf_dir)).drop("end_after"), "created_at")


@query
def insert_or_ignore_txn(spark, sf_dir):
    t = market(spark, sf_dir)
    leaders = settle.winning_bids(t.bids).select("auction_id", F.col("bidder_id").alias("buyer_id"))
    incoming = settle.sale_details(t.auctions, t.items).join(leaders, "auction_id").select(
        F.col("auction_id").alias("id"), "auction_id", "buyer_id", "seller_id", "amount",
        F.lit("pending").alias("status"), clock.as_of_column(AS_OF).alias("created_at"))
    return _iso(settle.insert_or_ignore(t.transactions, incoming), "created_at")


@query
def apply_bid_to_auction(spark, sf_dir):
    updated = replay.apply_bids(source.auctions(spark, sf_dir),
                                replay.accepted(_replayed(spark, sf_dir, SIX_HOURS)))
    return _iso(updated, "end_time").select("id", "starting_price", "current_price", "end_time",
                                            "status")


@query
def seed_bid_ladder(spark, sf_dir):
    t = market(spark, sf_dir)
    counted = t.auctions.join(settle.bid_counts(t.bids).withColumnRenamed("auction_id", "id"), "id")
    buyers = t.users.where(F.col("role") == "buyer")
    return _iso(ladder.seed_bid_ladder(counted, buyers, AS_OF), "created_at")


@query
def sink_json_feed(spark, sf_dir):
    return json_documents(views.open_auctions_feed(market(spark, sf_dir), views.HOME_FEED_ROWS))


@query
def sink_json_page(spark, sf_dir):
    return json_documents(views.auction_page(market_with_payments(spark, sf_dir), AS_OF))


@query
def sink_json_wins(spark, sf_dir):
    return json_documents(views.wins_by_buyer(market_with_payments(spark, sf_dir)))


@query
def erase_cascade(spark, sf_dir):
    t = market(spark, sf_dir)
    gone = source.users_in_debt(spark, sf_dir)
    return _ids_by_table(erase.erase_cascade(t, gone))


def _ids_by_table(t: Tables) -> DataFrame:
    rows = [df.select(F.lit(name).alias("table_name"), "id",
                      F.col("winner_id") if name == "auctions"
                      else F.lit(None).cast("long").alias("winner_id"))
            for name, df in t.items_by_name().items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).union(rows[4])


# Filters, joins and scalar functions


@query
def auction_card(spark, sf_dir):
    return views.auction_cards(market(spark, sf_dir))


@query
def filter_due(spark, sf_dir):
    t = _replayed_market(spark, sf_dir)
    return _iso(settle.due_auctions(t.auctions, AS_OF), "end_time").select("id", "end_time")


@query
def due_sort(spark, sf_dir):
    return _iso(settle.due_in_order(_replayed_market(spark, sf_dir).auctions, AS_OF), "end_time")


@query
def category_filter(spark, sf_dir):
    return views.category_feed(market(spark, sf_dir), "PROMO")


@query
def scalars_text(spark, sf_dir):
    return source.listing_feed(spark, sf_dir).select(
        "feed_id", text.norm_text(F.col("title")).alias("norm_title"),
        text.utf16_length(text.norm_text(F.col("title"))).cast("long").alias("title_units"),
        text.norm_email(F.concat(F.lit("\t "), text.norm_text(F.col("category")),
                                 F.lit("@Example.COM "))).alias("email"),
        text.safe_image_url(text.norm_text(F.col("imageUrl"))).alias("safe_url"),
        text.to_number(F.col("startingPrice")).alias("number"),
        text.coerce_id(F.col("startingPrice")).alias("id"),
        clock.iso_utc(clock.parse_zoned(text.norm_text(F.col("endTime")))).alias("end"))


@query
def scalars_auction(spark, sf_dir):
    t = market_with_payments(spark, sf_dir)
    payment = t.transactions.select(F.col("auction_id").alias("auctionId"),
                                    F.col("status").alias("payment"))
    rows = views.auction_detail(t, AS_OF).join(payment, "auctionId", "left")
    now, end = clock.as_of_column(AS_OF), F.col("endTime").cast("timestamp")
    count, price = F.col("bidCount"), F.col("currentPrice")
    viewer = F.col("auctionId") % 150 + 1
    return rows.select(
        "auctionId", "sellerName", "winnerName", "isBiddable",
        money.money_inr(price * 12345).alias("money"),
        clock.time_left(end, now).alias("timeLeft"), clock.time_ago(end, now).alias("endedAgo"),
        labels.min_next_bid(count, F.col("startingPrice"), price).alias("minNextBid"),
        labels.price_label(count).alias("priceLabel"),
        labels.price_label(count, detail=True).alias("detailLabel"),
        labels.bid_count_label(count).alias("countLabel"),
        labels.listing_state(F.col("status"), F.col("payment"), F.col("winnerId")).alias("listing"),
        labels.win_state(F.col("payment")).alias("win"),
        labels.is_unpaid(F.col("payment")).alias("unpaid"),
        labels.bidder_label(F.col("winnerId"), viewer, F.col("winnerName")).alias("bidder"),
        labels.auction_outcome(F.col("isBiddable"), F.col("status"), F.col("winnerId"),
                               F.col("winnerName"), viewer, F.col("payment"), price).alias("notice"))


@query
def scalars_bids(spark, sf_dir):
    rows = views.bids_by_user(market(spark, sf_dir))
    return rows.select(
        "userId", "auctionId", labels.bid_state(F.col("status"), F.col("isWinning")).alias("state"),
        money.money_inr(F.col("myBid")).alias("myBid"),
        clock.time_ago(F.col("lastBidAt").cast("timestamp"), clock.as_of_column(AS_OF)).alias("ago"))


@query
def parse_subscribe(spark, sf_dir):
    return _iso(rooms.parse_subscribe(source.subscribe_feed(spark, sf_dir)), "ts")


# Aggregations


@query
def bids_by_user(spark, sf_dir):
    return views.bids_by_user(market(spark, sf_dir))


@query
def bid_count(spark, sf_dir):
    t = market(spark, sf_dir)
    return views.with_bid_count(t.auctions.select(F.col("id").alias("auctionId")), t.bids)


@query
def buyer_stats(spark, sf_dir):
    return dashboard.buyer_stats(market_with_payments(spark, sf_dir))


@query
def seller_stats(spark, sf_dir):
    return dashboard.seller_stats(market(spark, sf_dir))


@query
def dashboard_role_view(spark, sf_dir):
    return dashboard.dashboard_role_view(market_with_payments(spark, sf_dir))


@query
def invariant_max_eq_current(spark, sf_dir):
    return integrity.price_invariant(market(spark, sf_dir))


@query
def room_viewers(spark, sf_dir):
    return rooms.room_viewers(rooms.parse_subscribe(source.subscribe_feed(spark, sf_dir)))


# Ordered operators


def _outcomes(df: DataFrame) -> DataFrame:
    return _iso(df, "end_after").select("id", "auction_id", "bidder_id", "amount", "outcome",
                                        "price_after", "end_after", "extended")


@query
def replay_bids(spark, sf_dir):
    return _outcomes(_replayed(spark, sf_dir))


@query
def replay_bids_6h(spark, sf_dir):
    return _outcomes(_replayed(spark, sf_dir, SIX_HOURS))


def _extended_by(spark, sf_dir, extension_ms: int) -> DataFrame:
    return replay.replay_bids(source.auctions(spark, sf_dir), source.items(spark, sf_dir),
                              source.bid_attempts(spark, sf_dir), SIX_HOURS, extension_ms)


@query
def replay_bids_short_extension(spark, sf_dir):
    return _outcomes(_extended_by(spark, sf_dir, SIX_HOURS // 3))


@query
def replay_bids_long_extension(spark, sf_dir):
    return _outcomes(_extended_by(spark, sf_dir, SIX_HOURS * 2))


@query
def winning_bid(spark, sf_dir):
    return _iso(settle.winning_bids(market(spark, sf_dir).bids), "created_at")


@query
def bid_history_topk(spark, sf_dir):
    return views.bid_history_topk(market(spark, sf_dir))


@query
def bid_history_top3(spark, sf_dir):
    return views.bid_history_topk(market(spark, sf_dir), 3)


@query
def bids_received_topk(spark, sf_dir):
    return views.bids_received_topk(market(spark, sf_dir))


@query
def replay_checkout(spark, sf_dir):
    t = market(spark, sf_dir)
    return checkout.replay_checkout(
        t.transactions, source.payment_attempts(t.auctions)).drop("created_at")


@query
def replay_login_throttle(spark, sf_dir):
    return throttle.replay_login_throttle(source.login_attempts(spark, sf_dir)).drop("created_at")


@query
def replay_login_throttle_3d(spark, sf_dir):
    return throttle.replay_login_throttle(source.login_attempts(spark, sf_dir), 3,
                                          THREE_DAYS).drop("created_at")


# Feeds, sorted views and composite views


@query
def open_auctions_feed(spark, sf_dir):
    return views.open_auctions_feed(market(spark, sf_dir))


@query
def home_feed(spark, sf_dir):
    return views.open_auctions_feed(market(spark, sf_dir), views.HOME_FEED_ROWS)


@query
def my_bids_sort(spark, sf_dir):
    return views.my_bids_sorted(market(spark, sf_dir))


@query
def listings_sort(spark, sf_dir):
    return views.listings_sorted(market(spark, sf_dir))


@query
def wins_sort(spark, sf_dir):
    return views.wins_sorted(market(spark, sf_dir))


@query
def auction_detail(spark, sf_dir):
    return views.auction_detail(market(spark, sf_dir), AS_OF)


@query
def auction_page(spark, sf_dir):
    t = market_with_payments(spark, sf_dir)
    viewers = t.auctions.select((F.col("id") % 150 + 1).alias("viewer_id"),
                                F.col("id").alias("auction_id"))
    page = views.auction_page(t, AS_OF, viewers)
    return page.select(
        "auctionId", F.col("auction.title").alias("title"),
        F.col("auction.isBiddable").alias("isBiddable"),
        F.array_join(F.transform("bids", lambda b: F.concat(
            b["id"].cast("string"), F.lit(":"), b["bidderName"])), ",").alias("bids"),
        F.col("payment.status").alias("payment"), F.col("viewer.id").alias("viewerId"),
        F.col("viewer.firstName").alias("viewerName"),
        F.col("viewer.isSeller").alias("viewerIsSeller"))


@query
def listings_by_seller(spark, sf_dir):
    return views.listings_by_seller(market_with_payments(spark, sf_dir))


@query
def wins_by_buyer(spark, sf_dir):
    return views.wins_by_buyer(market_with_payments(spark, sf_dir))


@query
def transaction_by_auction(spark, sf_dir):
    return views.transaction_by_auction(market_with_payments(spark, sf_dir))


def _settled(spark, sf_dir):
    t = _replayed_market(spark, sf_dir)
    return settle.settle_auctions(t.auctions, t.items, t.bids, t.transactions, AS_OF)


@query
def settle_auctions(spark, sf_dir):
    return _iso(_settled(spark, sf_dir)[0], "end_time").select(
        "id", "current_price", "end_time", "status", "winner_id")


@query
def settle_transactions(spark, sf_dir):
    return _iso(_settled(spark, sf_dir)[1], "created_at")


# Changes of a stored market, version by version


def _settled_version(spark, sf_dir):
    def build():
        path = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
        versions.create(source.base_tables(spark, sf_dir), path)
        stored.apply_attempts(spark, path, source.bid_attempts(spark, sf_dir).where(
            F.col("created_at") <= clock.as_of_column(AS_OF)))
        return stored.settle_due(spark, path, AS_OF)

    return _once(spark, "settled_version", sf_dir, build)


@query
def stored_auctions(spark, sf_dir):
    return _iso(_settled_version(spark, sf_dir).read(spark, "auctions"), "end_time").select(
        "id", "current_price", "end_time", "status", "winner_id")


@query
def stored_transactions(spark, sf_dir):
    return _iso(_settled_version(spark, sf_dir).read(spark, "transactions"), "created_at")


@query
def stored_due_ticks(spark, sf_dir):
    """Closed at the second of two ticks what the first had left."""
    path = f"{shared_dir(spark)}/ticks-{uuid.uuid4().hex}"
    versions.create(_replayed_market(spark, sf_dir), path)
    half_day = F.expr("interval 12 hours")
    stored.settle_due(spark, path, clock.as_of_column(AS_OF) - half_day)
    return _iso(stored.settle_due(spark, path, AS_OF).read(spark, "auctions"), "end_time").select(
        "id", "current_price", "end_time", "status", "winner_id")


@query
def stored_erasure(spark, sf_dir):
    path = _settled_version(spark, sf_dir).path
    return _ids_by_table(stored.erase_users(
        spark, path, source.users_in_debt(spark, sf_dir)).tables(spark))


@query
def sale_details(spark, sf_dir):
    t = market(spark, sf_dir)
    return settle.sale_details(t.auctions, t.items)


@query
def market_snapshot_query(spark, sf_dir):
    """The flagship: attempts to settled auctions with their bids and invoice."""
    t = _snapshot(spark, sf_dir)
    invoices = t.transactions.select(F.col("auction_id").alias("id"), "buyer_id", "seller_id",
                                     F.col("amount").alias("invoice"))
    counts = settle.bid_counts(t.bids).withColumnRenamed("auction_id", "id")
    return _iso(t.auctions.join(counts, "id", "left").join(invoices, "id", "left"), "end_time").select(
        "id", "status", "current_price", "end_time", "winner_id",
        F.coalesce("bid_count", F.lit(0)).alias("bid_count"), "seller_id", "invoice")


QUERIES["market_snapshot"] = QUERIES.pop("market_snapshot_query")
QUERIES["scan_tables"] = QUERIES.pop("scan_tables_profile")


# Validation


@query
def validate_listings(spark, sf_dir):
    valid, _ = validate.validate_listings(source.listing_feed(spark, sf_dir), AS_OF)
    return _iso(valid, "end_time")


@query
def validate_listings_rejected(spark, sf_dir):
    _, rejected = validate.validate_listings(source.listing_feed(spark, sf_dir), AS_OF)
    return rejected.select("feed_id", _joined(), "first_error")


@query
def validate_registrations(spark, sf_dir):
    return validate.validate_registrations(source.registration_feed(spark, sf_dir))[0]


@query
def validate_registrations_rejected(spark, sf_dir):
    _, rejected = validate.validate_registrations(source.registration_feed(spark, sf_dir))
    return rejected.select("feed_id", _joined(), "first_error")


@query
def validate_logins(spark, sf_dir):
    return validate.validate_logins(source.login_feed(spark, sf_dir))[0]


@query
def validate_logins_rejected(spark, sf_dir):
    _, rejected = validate.validate_logins(source.login_feed(spark, sf_dir))
    return rejected.select("feed_id", _joined(), "first_error")


def damaged_market(spark, sf_dir) -> Tables:
    """The stored market with defects in every table."""
    t = market(spark, sf_dir)
    no_phone = F.col("phone").isNull()
    users = t.users.withColumn("role", F.when(no_phone, "admin").otherwise(F.col("role")))
    users = users.withColumn("last_name", F.when(F.col("first_name") != "BUILDING", F.col("last_name")))
    users = users.unionByName(t.users.where("phone IS NULL").withColumns({
        "id": F.col("id") + 1_000_000, "email": F.upper("email")}))
    items = t.items.withColumn("seller_id", F.when(
        F.col("category") == "PROMO", F.col("seller_id") + 5_000_000).otherwise(F.col("seller_id")))
    price = F.col("starting_price")
    auctions = t.auctions.withColumns({
        "current_price": F.when(price < 20, -price).otherwise(F.col("current_price")),
        "end_time": F.when(price > 100, F.col("start_time")).otherwise(F.col("end_time")),
        "status": F.when(F.col("status") == "cancelled", "paused").otherwise(F.col("status")),
        "winner_id": F.when(F.col("winner_id") < 50, F.col("winner_id") + 9_000_000)
        .otherwise(F.col("winner_id"))})
    bids = t.bids.withColumns({
        "amount": F.when(F.col("amount") < 30, F.lit(0)).otherwise(F.col("amount")),
        "auction_id": F.when(F.col("bidder_id") < 10, F.col("auction_id") + 7_000_000)
        .otherwise(F.col("auction_id"))})
    amount = F.col("amount")
    transactions = t.transactions.withColumn(
        "status", F.when(amount > 200, "refunded").otherwise(F.col("status")))
    transactions = transactions.unionByName(t.transactions.where("amount < 100").withColumns({
        "id": F.col("id") + 3_000_000, "amount": F.lit(0).cast("long")}))
    return Tables(users, items, auctions, bids, transactions)


@query
def check_domains(spark, sf_dir):
    return integrity.check_domains(damaged_market(spark, sf_dir))


@query
def check_ranges(spark, sf_dir):
    return integrity.check_ranges(damaged_market(spark, sf_dir))


@query
def check_not_null(spark, sf_dir):
    return integrity.check_not_null(damaged_market(spark, sf_dir))


@query
def check_unique(spark, sf_dir):
    return integrity.check_unique(damaged_market(spark, sf_dir))


@query
def check_foreign_keys(spark, sf_dir):
    return integrity.check_foreign_keys(damaged_market(spark, sf_dir))


@query
def check_integrity(spark, sf_dir):
    found = integrity.check_integrity(damaged_market(spark, sf_dir))
    return found.groupBy("rule", "table_name").agg(F.count(F.lit(1)).alias("violations"))


# Rooms and streams


def _updates(spark, sf_dir):
    return source.bid_attempts(spark, sf_dir).select(
        "id", "auction_id", F.col("created_at").alias("ts"))


@query
def update_audience(spark, sf_dir):
    subscriptions = rooms.parse_subscribe(source.subscribe_feed(spark, sf_dir))
    return rooms.update_audience(subscriptions, _updates(spark, sf_dir)).drop("ts")


@query
def viewer_sessions(spark, sf_dir):
    return _iso(rooms.viewer_sessions(source.subscribe_feed(spark, sf_dir), SESSION_GAP_MS),
                "session_start", "session_end")


def _live_bids(spark, sf_dir, events: DataFrame) -> DataFrame:
    return live_bids.stream_updates(
        source.bid_attempts(spark, sf_dir, events), source.auctions(spark, sf_dir),
        source.items(spark, sf_dir), SIX_HOURS)


def live_folder(spark, sf_dir) -> str:
    """Where the bid stream wrote its updates for all attempts of the event table."""
    def build() -> str:
        return run_to_folder(_live_bids(spark, sf_dir, source.stream_events(spark, sf_dir)),
                             "bid-updates")

    return _once(spark, "updates", sf_dir, build)


def live_updates(spark, sf_dir) -> DataFrame:
    return spark.read.schema(live_bids.UPDATE_SCHEMA).parquet(live_folder(spark, sf_dir))


@query
def stream_bids(spark, sf_dir):
    return _outcomes(live_bids.bid_outcomes(live_updates(spark, sf_dir)))


@query
def stream_close(spark, sf_dir):
    return _iso(live_bids.closings(live_updates(spark, sf_dir)), "end_time")


def _update_stream(spark, sf_dir) -> DataFrame:
    return read_stream(spark, live_folder(spark, sf_dir), live_bids.UPDATE_SCHEMA)


@query
def stream_price_ticks(spark, sf_dir):
    stream = _update_stream(spark, sf_dir)
    ticks = live_bids.price_ticks(live_bids.accepted_updates(stream))
    return run_updates(ticks, "ticks", "auctionId")


@query
def stream_bid_updates(spark, sf_dir):
    t = source.base_tables(spark, sf_dir)
    documents = run_batches(_update_stream(spark, sf_dir), "documents", lambda batch:
                            live_bids.bid_documents(batch, t, AS_OF))
    return documents.select("type", "auctionId", "extended",
                            F.col("auction.currentPrice").alias("currentPrice"),
                            F.size("bids").cast("long").alias("bids"),
                            F.col("bids")[0]["amount"].alias("highest"))


@query
def stream_closed(spark, sf_dir):
    t = source.base_tables(spark, sf_dir)
    documents = run_batches(_update_stream(spark, sf_dir), "closed", lambda batch:
                            live_bids.closed_documents(batch, t, AS_OF))
    return documents.select("type", "auctionId", F.col("auction.status").alias("status"),
                            F.col("auction.winnerName").alias("winnerName"),
                            F.col("auction.currentPrice").alias("currentPrice"),
                            F.col("auction.bidCount").alias("bidCount"))


@query
def stream_throttle(spark, sf_dir):
    attempts = source.login_attempts(spark, sf_dir, source.stream_events(spark, sf_dir))
    return run_to_table(live_throttle.stream_throttle(attempts, 3, THREE_DAYS),
                        "logins").drop("created_at")


@query
def stream_sessions(spark, sf_dir):
    signals = source.subscribe_feed(spark, sf_dir, source.stream_events(spark, sf_dir))
    sessions = live_rooms.stream_sessions(signals, f"{SESSION_GAP_MS} milliseconds")
    return _iso(run_to_table(sessions, "sessions"), "session_start", "session_end")


def _live_rooms(spark, sf_dir) -> DataFrame:
    feed = source.subscribe_feed(spark, sf_dir, source.stream_events(spark, sf_dir))
    return run_updates(live_rooms.stream_rooms(rooms.parse_subscribe(feed)), "rooms", "client_id")


@query
def stream_rooms(spark, sf_dir):
    return _iso(_live_rooms(spark, sf_dir), "ts")


@query
def stream_audience(spark, sf_dir):
    # Bids are judged in the stream that counts clients: its micro-batches bring subscriptions
    # and updates of the same events, which two sources would cut at different places.
    events = source.stream_events(spark, sf_dir)
    feed = source.subscribe_feed(spark, sf_dir, events)
    sent = live_bids.accepted_updates(_live_bids(spark, sf_dir, events)).select(
        "id", "auction_id", F.col("created_at").alias("ts"))
    reached = live_rooms.stream_audience(rooms.parse_subscribe(feed), sent)
    return run_batches(reached, "audience", live_rooms.audience).drop("batch_id")


def live_registrations_folder(spark, sf_dir) -> str:
    """Where the registration stream keeps the outcome of every form and the new users."""
    def build() -> str:
        home = f"{shared_dir(spark)}/registrations-{uuid.uuid4().hex}"
        live_registrations.run_registrations(
            source.registration_feed(spark, sf_dir, source.stream_customers(spark, sf_dir)),
            source.users(spark, sf_dir), home, AS_OF)
        return home

    return _once(spark, "registrations", sf_dir, build)


@query
def stream_registrations(spark, sf_dir):
    home = live_registrations_folder(spark, sf_dir)
    return _iso(live_registrations.registered(spark, home), "created_at")


@query
def stream_registration_outcomes(spark, sf_dir):
    home = live_registrations_folder(spark, sf_dir)
    return live_registrations.outcomes(spark, home).select("feed_id", "outcome", "first_error")


@query
def stream_closed_ticks(spark, sf_dir):
    return live_bids.closed_ticks(live_bids.closings(live_updates(spark, sf_dir)))


@query
def stream_invoices(spark, sf_dir):
    return _iso(live_bids.closing_invoices(live_updates(spark, sf_dir)), "created_at")


# Views for one request


@query
def auction_detail_one(spark, sf_dir):
    return views.auction_detail(market(spark, sf_dir), AS_OF, auction_id=ONE_AUCTION)


@query
def bid_history_one(spark, sf_dir):
    return views.bid_history_topk(market(spark, sf_dir), auction_id=ONE_AUCTION)


@query
def bids_by_user_one(spark, sf_dir):
    return views.bids_by_user(market(spark, sf_dir), user_id=ONE_BUYER)


@query
def listings_by_seller_one(spark, sf_dir):
    return views.listings_by_seller(market_with_payments(spark, sf_dir), seller_id=ONE_SELLER)


@query
def bids_received_one(spark, sf_dir):
    return views.bids_received_topk(market(spark, sf_dir), seller_id=ONE_SELLER)


@query
def wins_by_buyer_one(spark, sf_dir):
    return views.wins_by_buyer(market_with_payments(spark, sf_dir), buyer_id=ONE_BUYER)


@query
def transaction_one(spark, sf_dir):
    return views.transaction_by_auction(market_with_payments(spark, sf_dir), auction_id=ONE_AUCTION)


@query
def public_user_one(spark, sf_dir):
    return views.public_users(source.base_tables(spark, sf_dir), user_id=ONE_BUYER)


@query
def bid_messages(spark, sf_dir):
    return replay.with_message(_replayed(spark, sf_dir)).select("id", "outcome", "message")


@query
def checkout_messages(spark, sf_dir):
    t = market(spark, sf_dir)
    judged = checkout.replay_checkout(t.transactions, source.payment_attempts(t.auctions))
    return replay.with_message(judged, checkout.CHECKOUT_ERRORS).select("id", "outcome", "message")
