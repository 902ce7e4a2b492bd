"""Settlement, views, ingestion, erasure and integrity on a small seeded market."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import at, millis

from gavel import schemas
from gavel.operators import ingest, integrity
from gavel.operators.erase import erase_cascade
from gavel.operators.ladder import seed_bid_ladder
from gavel.operators.settle import insert_or_ignore, settle_auctions, winning_bids
from gavel.plans import dashboard, views
from gavel.plans.snapshot import market_snapshot
from gavel.sources.sinks import read_listing_batches, write_json_feed, write_listing_batch
from gavel.streaming.bids import close_due
from gavel.sources.tables import Tables, append_rows, scan_tables, write_tables

HOUR = 3_600_000
NOW = at(100 * HOUR)
# Starting price, current price, bids and time left of the demo auctions.
DEMO = [(1, 2, 900_000, 1_200_000, 23, 15_825_000), (2, 1, 500_000, 680_000, 15, 8_130_000),
        (3, 2, 300_000, 540_000, 42, 21_600_000), (4, 3, 850_000, 1_000_000, 8, 106_800_000)]


@pytest.fixture(scope="module")
def seeded(spark) -> Tables:
    users = [(i, f"F{i}", f"L{i}", f"User{i}@x.test", "1", "seller" if i < 4 else "buyer", at(0))
             for i in range(1, 7)]
    items = [(a, seller, f"T{a}", "", "Diamonds", "", at(0)) for a, seller, *_ in DEMO]
    items.append((5, 1, "unlisted", "", "Diamonds", "", at(0)))
    auctions = [(a, a, start, price, at(0), at(100 * HOUR + left), "open", None, at(0))
                for a, _, start, price, _, left in DEMO]
    adf = spark.createDataFrame(auctions, schemas.AUCTIONS)
    counts = spark.createDataFrame([(a, n) for a, _, _, _, n, _ in DEMO], "id long, bid_count long")
    buyers = spark.createDataFrame([(6,), (4,), (5,)], "id long")
    rungs = seed_bid_ladder(adf.join(counts, "id"), buyers, NOW)
    bids = rungs.select((F.col("auction_id") * 100 + F.col("step")).alias("id"), "auction_id",
                        "bidder_id", "amount", "created_at")
    return Tables(spark.createDataFrame(users, schemas.USERS), spark.createDataFrame(items, schemas.ITEMS),
                  adf, bids.cache(), schemas.empty(spark, schemas.TRANSACTIONS))


def test_ladder_matches_the_demo_market(seeded):
    rows = sorted(seeded.bids.collect(), key=lambda r: r.id)
    assert len(rows) == 88
    for a, _, start, price, n, _ in DEMO:
        mine = [r for r in rows if r.auction_id == a]
        # Half up, as the rounding of the demo script.
        assert [r.amount for r in mine] == [
            start + (2 * (price - start) * (i + 1) + n) // (2 * n) for i in range(n)]
        assert [r.bidder_id for r in mine] == [4 + i % 3 for i in range(n)]
        assert [millis(r.created_at) for r in mine] == [
            100 * HOUR - (n - i) * 420_000 for i in range(n)]
    assert integrity.price_invariant(seeded).collect()[0].asDict() == {
        "auctions_with_bids": 4, "violations": 0}


def test_feed_shuffles_only_its_own_rows(spark, seeded, tmp_path):
    stored = scan_tables(spark, write_tables(seeded, f"{tmp_path}/four"))
    plan = views.open_auctions_feed(stored)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan


def test_feed_puts_the_soonest_end_first(seeded):
    rows = views.open_auctions_feed(seeded, 3).collect()
    assert [r.auctionId for r in rows] == [2, 1, 3]
    assert [r.bidCount for r in rows] == [15, 23, 42]
    assert rows[0].sellerName == "F1 L1"


def test_bids_by_user_counts_everybody_on_the_card(seeded):
    rows = views.bids_by_user(seeded, 4).collect()
    assert {r.auctionId: r.bidCount for r in rows} == {1: 23, 2: 15, 3: 42, 4: 8}
    assert {r.auctionId: r.myBidCount for r in rows} == {1: 8, 2: 5, 3: 14, 4: 3}
    assert [r.isWinning for r in rows] == sorted([r.isWinning for r in rows], reverse=True)
    everyone = views.bids_by_user(seeded).where("userId = 4").collect()
    assert {tuple(r) for r in everyone} == {tuple(r) for r in rows}


def test_history_and_received_take_the_top_rows(seeded):
    history = views.bid_history_topk(seeded, 5).where("auctionId = 3").orderBy("position").collect()
    assert [r.position for r in history] == [1, 2, 3, 4, 5]
    assert history[0].isHighest and history[0].amount == 540_000
    received = views.bids_received_topk(seeded).collect()
    by_seller = {s: [r for r in received if r.sellerId == s] for s in (1, 2, 3)}
    assert {s: len(r) for s, r in by_seller.items()} == {1: 10, 2: 10, 3: 8}
    one = views.bids_received_topk(seeded, seller_id=2).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in by_seller[2]}
    single = views.bid_history_topk(seeded, 5, auction_id=3).collect()
    assert {tuple(r) for r in single} == {tuple(r) for r in history}
    # Seller 2 has two auctions whose bids interleave.
    assert {r.auctionId for r in by_seller[2]} == {1, 3}


def test_rank_limit_runs_before_the_shuffle(spark, seeded, tmp_path):
    stored = scan_tables(spark, write_tables(seeded, f"{tmp_path}/three"))
    plan = views.bid_history_topk(stored)._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)


def test_settlement_closes_only_what_is_due(spark, seeded):
    as_of = at(100 * HOUR + 15_825_000)  # the very end of auction 1; 3 and 4 still run
    auctions, invoices = settle_auctions(seeded.auctions, seeded.items, seeded.bids,
                                         seeded.transactions, as_of)
    rows = {r.id: r for r in auctions.collect()}
    assert {a: r.status for a, r in rows.items()} == {1: "closed", 2: "closed", 3: "open", 4: "open"}
    assert rows[1].winner_id == 5 and rows[3].winner_id is None
    got = {r.auction_id: (r.buyer_id, r.seller_id, r.amount, r.status) for r in invoices.collect()}
    assert got == {1: (5, 2, 1_200_000, "pending"), 2: (6, 1, 680_000, "pending")}
    # A second run at the same instant has nothing to do.
    again, none = settle_auctions(auctions, seeded.items, seeded.bids, invoices, as_of)
    assert none.count() == 0
    assert {r.id: (r.status, r.winner_id) for r in again.collect()} == {
        a: (r.status, r.winner_id) for a, r in rows.items()}
    assert settle_auctions(seeded.auctions, seeded.items, seeded.bids, seeded.transactions,
                           at(0))[1].count() == 0


def test_ties_go_to_the_first_winner_and_the_latest_history_row(spark, seeded):
    bids = spark.createDataFrame([(1, 1, 4, 10, at(0)), (2, 1, 5, 10, at(1)), (3, 1, 6, 9, at(2))],
                                 schemas.BIDS)
    assert winning_bids(bids).collect()[0].bidder_id == 4
    t = Tables(seeded.users, seeded.items, seeded.auctions, bids, seeded.transactions)
    assert [r.id for r in views.bid_history_topk(t).orderBy("position").collect()] == [2, 1, 3]


def test_an_existing_invoice_wins(spark):
    def txn(*rows):
        return spark.createDataFrame(list(rows), schemas.TRANSACTIONS)

    existing = txn((1, 1, 10, 20, 5, "paid", at(0)))
    incoming = txn((7, 1, 11, 20, 6, "pending", at(1)), (8, 2, 12, 20, 7, "pending", at(1)),
                   (9, 2, 13, 20, 8, "pending", at(1)))
    assert [(r.id, r.buyer_id) for r in insert_or_ignore(existing, incoming).collect()] == [(8, 12)]


def test_later_attempts_meet_earlier_bids(spark, seeded):
    """A market that already has bids continues from its price."""
    attempts = spark.createDataFrame(
        [(901, 1, 4, 1_200_000, at(100 * HOUR)), (902, 1, 4, 1_200_001, at(100 * HOUR + 1)),
         (903, 1, 2, 2_000_000, at(100 * HOUR + 2))], "id long, auction_id long, bidder_id long, "
        "amount long, created_at timestamp")
    t = market_snapshot(seeded, attempts, at(100 * HOUR + 15_825_000))
    assert t.bids.count() == 89
    first = t.auctions.where("id = 1").collect()[0]
    assert (first.current_price, first.winner_id, first.status) == (1_200_001, 4, "closed")


def test_dashboards(seeded):
    t = seeded
    auctions, invoices = settle_auctions(t.auctions, t.items, t.bids, t.transactions,
                                         at(100 * HOUR + 15_825_000))
    t = Tables(t.users, t.items, auctions, t.bids, invoices)
    buyers = {r.userId: r for r in dashboard.buyer_stats(t).collect()}
    assert (buyers[5].activeBids, buyers[5].paymentLabel, buyers[5].paymentValue) == (2, "Payment Due", 1)
    assert (buyers[4].paymentLabel, buyers[4].paymentValue) == ("Auctions Won", 0)
    assert sum(b.currentlyWinning for b in buyers.values()) == 2
    sellers = {r.userId: (r.activeListings, r.bidsReceived, r.highestBid)
               for r in dashboard.seller_stats(t).collect()}
    assert sellers[2] == (1, 65, "₹5,40,000")
    assert sellers[1] == (0, 15, "—")
    assert sellers[3] == (1, 8, "₹10,00,000")
    assert sellers[4] == (0, 0, "—")
    view = dashboard.dashboard_role_view(t).collect()
    assert len(view) == 18 and {r.label for r in view if r.role == "seller"} == {
        "Active Listings", "Bids Received", "Highest Bid"}


def test_unlisted_items_stay_in_the_listings(seeded):
    rows = views.listings_by_seller(seeded, 1).collect()
    assert [(r.itemId, r.auctionId, r.bidCount) for r in rows] == [(5, None, 0), (2, 2, 15)]


def test_page_is_one_document(spark, seeded):
    viewers = spark.createDataFrame([(1, 2), (4, 2)], "viewer_id long, auction_id long")
    rows = {r.viewer.id: r for r in views.auction_page(seeded, NOW, viewers).collect()}
    assert rows[1].viewer.isSeller and not rows[4].viewer.isSeller
    assert len(rows[1].bids) == 15 and rows[1].bids[0].amount == 680_000
    assert rows[1].payment is None and rows[1].auction.isBiddable
    assert {r.viewer for r in views.auction_page(seeded, NOW).collect()} == {None}


def test_one_invoice_for_each_auction_whatever_comes(spark, seeded):
    rows = [(1, 7, 10), (1, 7, 11), (None, 8, 12), (None, 8, 12), (3, 9, 13), (2, 9, 14), (None, 9, 15), (4, None, 16)]
    incoming = spark.createDataFrame(rows, "id long, auction_id long, buyer_id long")
    existing = spark.createDataFrame([(1, 5)], "id long, auction_id long")
    got = insert_or_ignore(existing, incoming).collect()
    assert sorted((r.auction_id, r.id) for r in got if r.id) == [(7, 1), (9, 2)]
    assert [r.buyer_id for r in got if r.id is None] == [12] and len(got) == 3


def test_a_repeated_registration_counts_once(spark, seeded):
    row = (1, "new@x.test", "A", "B", None, "buyer")
    valid = spark.createDataFrame([row, row, (2, *row[1:]), (3, "other@x.test", *row[2:])],
                                  "feed_id long, email string, first_name string, last_name string, phone string, role string")
    got = ingest.ingest_users(seeded.users, valid, NOW).collect()
    assert sorted((r.id, r.email) for r in got) == [(7, "new@x.test"), (8, "other@x.test")]


def test_ingest_users_takes_the_first_free_email(spark, seeded):
    valid = spark.createDataFrame(
        [(3, "a", "b", "new@x.test", "1", "buyer"), (1, "c", "d", "user1@x.test", "1", "buyer"),
         (2, "e", "f", "new@x.test", "1", "seller"), (9, "g", "h", "z@x.test", "1", "buyer")],
        "feed_id long, first_name string, last_name string, email string, phone string, role string")
    got = ingest.ingest_users(seeded.users, valid, NOW).orderBy("id").collect()
    assert [(r.id, r.first_name, r.email) for r in got] == [(7, "e", "new@x.test"), (8, "g", "z@x.test")]


def test_ingest_listings_writes_both_halves(spark, seeded):
    valid = spark.createDataFrame(
        [(4, 1, "t", "d", "Diamonds", "u", 50, at(0)), (2, 2, "s", "d", "Diamonds", "u", 60, at(1))],
        "feed_id long, seller_id long, title string, description string, category string, "
        "image_url string, starting_price long, end_time timestamp")
    items, auctions = ingest.ingest_listings(seeded.items, seeded.auctions, valid, NOW)
    assert [(r.id, r.title) for r in items.orderBy("id").collect()] == [(6, "s"), (7, "t")]
    rows = auctions.orderBy("id").collect()
    assert [(r.id, r.item_id, r.current_price, r.status) for r in rows] == [
        (5, 6, 60, "open"), (6, 7, 50, "open")]
    assert {millis(r.start_time) for r in rows} == {100 * HOUR}


def test_erasing_a_user_cascades(spark, seeded):
    auctions, invoices = settle_auctions(seeded.auctions, seeded.items, seeded.bids,
                                         seeded.transactions, at(200 * HOUR))
    t = Tables(seeded.users, seeded.items, auctions, seeded.bids, invoices)
    gone = spark.createDataFrame([(1,), (5,)], "id long")
    left = erase_cascade(t, gone)
    assert sorted(r.id for r in left.users.collect()) == [2, 3, 4, 6]
    assert sorted(r.id for r in left.items.collect()) == [1, 3, 4]
    winners = {r.id: r.winner_id for r in left.auctions.collect()}
    before = {r.id: r.winner_id for r in t.auctions.collect()}
    assert winners == {a: None if before[a] == 5 else before[a] for a in (1, 3, 4)}
    assert left.bids.where("bidder_id = 5 OR auction_id = 2").count() == 0
    assert left.bids.count() == t.bids.where("bidder_id <> 5 AND auction_id <> 2").count()
    assert {r.auction_id for r in left.transactions.collect()} == {
        a for a in (1, 3, 4) if before[a] != 5}
    assert integrity.check_foreign_keys(left).count() == 0


def test_integrity_names_each_broken_rule(spark, seeded):
    assert integrity.check_integrity(seeded).count() == 0
    bad_bids = spark.createDataFrame([(1, 1, 99, 0, at(0)), (1, 77, 4, 5, at(0))], schemas.BIDS)
    t = Tables(seeded.users.withColumn("email", F.lit("Same@x")), seeded.items,
               seeded.auctions.withColumn("end_time", F.col("start_time")), bad_bids,
               seeded.transactions)
    rules = {(r.rule, r.table_name) for r in integrity.check_integrity(t).collect()}
    assert rules == {("unique:email", "users"), ("range:end_time", "auctions"), ("range:amount", "bids"),
                     ("unique:id", "bids"), ("foreign_key:bidder_id", "bids"),
                     ("foreign_key:auction_id", "bids"), ("invariant:current_price", "auctions")}


def test_snapshots_round_trip_and_append(spark, seeded, tmp_path):
    path = write_tables(seeded, f"{tmp_path}/one")
    stored = scan_tables(spark, path)
    assert [stored.users.schema[f].dataType for f in stored.users.columns] == [
        f.dataType for f in schemas.USERS]
    assert stored.bids.count() == 88
    append_rows(spark.createDataFrame([(9001, 1, 4, 5, at(0))], schemas.BIDS), path, "bids")
    assert scan_tables(spark, path).bids.count() == 89
    with pytest.raises(Exception):
        write_tables(seeded, path)
    write_json_feed(views.open_auctions_feed(seeded), f"{tmp_path}/feed")
    first = spark.read.json(f"{tmp_path}/feed").where("auctionId = 2").collect()[0]
    assert first.sellerName == "F1 L1" and first.bidCount == 15


def test_a_closing_tick_reads_the_stored_market(spark, seeded, tmp_path):
    path = write_tables(seeded, f"{tmp_path}/five")
    closed = close_due(spark, path, at(200 * HOUR))
    assert {r.status for r in closed.auctions.collect()} == {"closed"}
    assert closed.transactions.count() == 4
    again = close_due(spark, write_tables(closed, f"{tmp_path}/six"), at(300 * HOUR))
    assert again.transactions.count() == 4


def test_tables_read_from_json_lines(spark, seeded, tmp_path):
    path = write_tables(seeded, f"{tmp_path}/json", fmt="json")
    stored = scan_tables(spark, path, fmt="json")
    assert stored.bids.exceptAll(seeded.bids).count() == 0 and stored.bids.count() == 88
    assert stored.auctions.exceptAll(seeded.auctions).count() == 0


def test_key_filters_reach_the_scan(spark, seeded, tmp_path):
    stored = scan_tables(spark, write_tables(seeded, f"{tmp_path}/two"))
    plan = views.wins_by_buyer(stored, 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(winner_id,5)" in plan and "EqualTo(status,closed)" in plan
    plan = views.auction_detail(stored, NOW, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "EqualTo(auction_id,3)" in plan
    bids = [line for line in plan.splitlines() if "EqualTo(auction_id,3)" in line]
    assert bids and all("amount" not in line for line in bids)  # counting reads one column


def test_feed_is_full_despite_orphans(spark, seeded):
    lost = seeded.items.where("id <> 1")  # the auction that would come first or later
    t = Tables(seeded.users, lost, seeded.auctions, seeded.bids, seeded.transactions)
    feed = views.open_auctions_feed(t, 3).collect()
    assert len(feed) == 3 and 1 not in {r.auctionId for r in feed}


def test_keyed_lists_cut_the_bids_before_they_are_counted(spark, seeded):
    for rows in (views.listings_by_seller(seeded, seller_id=2), views.wins_by_buyer(seeded, buyer_id=5)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
    mine = views.listings_by_seller(seeded, seller_id=2).collect()
    every = [r for r in views.listings_by_seller(seeded).collect() if r.sellerId == 2]
    assert sorted(mine, key=repr) == sorted(every, key=repr) and mine


def test_top_rows_are_hash_aggregates(spark, seeded):
    plan = winning_bids(seeded.bids)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_a_listing_batch_written_twice_counts_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    auctions = spark.createDataFrame([(7, 1), (8, 2)], "id long, item_id long")
    for _ in range(2):
        write_listing_batch(items, auctions, str(tmp_path), 0)
    write_listing_batch(items.selectExpr("id + 2 id", "title"), auctions, str(tmp_path), 1)
    # A batch of which only one half was written.
    items.write.parquet(f"{tmp_path}/items/batch_id=2")
    got_items, got_auctions = read_listing_batches(spark, str(tmp_path))
    assert sorted(r.id for r in got_items.collect()) == [1, 2, 3, 4]
    assert got_auctions.count() == 4


def test_erasure_plans_without_a_job(spark, seeded):
    gone, sc = spark.createDataFrame([(1,), (5,)], "id long"), spark.sparkContext
    sc.setJobGroup("plan of the erasure", "")
    try:
        erase_cascade(seeded, gone)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert not sc.statusTracker().getJobIdsForGroup("plan of the erasure")


def test_new_invoices_are_derived_once(spark):
    some = spark.createDataFrame([(1, 7, 10)], "id long, auction_id long, buyer_id long")
    plan = insert_or_ignore(some, some)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # the existing and the incoming ones


def test_texts_of_items_are_shuffled_once(spark, seeded, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views.auction_detail(seeded, NOW).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = capsys.readouterr().out.split("\n\n")
    wide = [n for n in nodes if ") Exchange\n" in n and "description#" in n]
    assert len(wide) == 1


def test_many_users_in_a_small_file_are_not_sent_to_the_driver(spark, seeded, tmp_path, capsys):
    spark.range(1_000_000).select(
        "id", *[F.lit("x").alias(c) for c in ("first_name", "last_name", "email", "phone", "role")],
        F.lit(NOW).alias("created_at")).write.parquet(f"{tmp_path}/users")
    users = spark.read.schema(schemas.USERS).parquet(f"{tmp_path}/users")
    t = Tables(users, users.select("id", F.col("id").alias("seller_id"), F.col("role").alias("title"),
                                   F.col("role").alias("description"), F.col("role").alias("category"),
                                   F.col("role").alias("image_url"), "created_at"),
               seeded.auctions, seeded.bids, seeded.transactions)
    views.wins_by_buyer(t).explain("formatted")
    nodes = [n for n in capsys.readouterr().out.split("\n\n") if "sellerName#" in n]
    assert nodes and not any(") BroadcastExchange\n" in n for n in nodes)
