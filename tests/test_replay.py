import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import at, millis

from gavel.operators.replay import accepted, apply_bids, replay_bids

W = 120_000
AUCTION = "id long, item_id long, starting_price long, current_price long, end_time timestamp, status string, bid_count long"
ATTEMPT = "id long, auction_id long, bidder_id long, amount double, created_at timestamp"


def sequential(auctions, sellers, attempts, window, extension=None):
    """The rules one attempt at a time: outcome, price, end and extension by id."""
    state = {a[0]: {"start": a[2], "price": a[3], "end": millis(a[4]), "open": a[5] == "open",
                    "bids": a[6], "seller": sellers[a[1]]} for a in auctions}
    out = {}
    for id_, auction, bidder, amount, ts in sorted(attempts, key=lambda r: (r[4], r[0])):
        t, s = millis(ts), state.get(auction)
        extended = False
        if auction is None:
            outcome = "NOT_FOUND"
        elif amount is None or amount <= 0 or amount != int(amount):
            outcome = "INVALID_AMOUNT"
        elif s is None:
            outcome = "NOT_FOUND"
        elif not s["open"] or s["end"] <= t:
            outcome = "CLOSED"
        elif s["seller"] == bidder:
            outcome = "OWN_ITEM"
        elif s["bids"] == 0 and amount < s["start"]:
            outcome = "BELOW_START"
        elif s["bids"] > 0 and amount <= s["price"]:
            outcome = "TOO_LOW"
        else:
            outcome = "ACCEPTED"
            extended = s["end"] - t <= window
            if extended:
                s["end"] = t + (window if extension is None else extension)
            s["price"], s["bids"] = int(amount), s["bids"] + 1
        taken = outcome == "ACCEPTED"
        out[id_] = (outcome, s["price"] if taken else None, s["end"] if taken else None, extended)
    return out, state


def random_market(seed, n_auctions=60, n_attempts=1500, hot_share=0.4):
    rng = np.random.default_rng(seed)
    auctions, sellers = [], {}
    for a in range(1, n_auctions + 1):
        sellers[a] = int(rng.integers(1, 6))
        bids = int(rng.integers(0, 2))
        start = int(rng.integers(1, 20))
        auctions.append((a, a, start, start + int(rng.integers(0, 5)), at(rng.integers(1, 9) * 60_000),
                         "cancelled" if a % 9 == 0 else "open", bids))
    attempts = []
    for i in range(n_attempts):
        auction = 1 if rng.random() < hot_share else int(rng.integers(1, n_auctions + 5))
        # Whole 30-second steps hit t = end and t = end - window often.
        t = int(rng.integers(0, 40)) * 30_000 + int(rng.choice([0, 0, 0, 1, -1]))
        amount = float(rng.integers(-1, 60)) + (0.5 if rng.random() < 0.03 else 0.0)
        attempts.append((i + 1, None if rng.random() < 0.02 else auction, int(rng.integers(1, 8)),
                         None if rng.random() < 0.02 else amount, at(max(t, 0))))
    return auctions, sellers, attempts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_matches_the_rules_applied_one_by_one(spark, hot, seed):
    auctions, sellers, attempts = random_market(seed)
    items = spark.createDataFrame(list(sellers.items()), "id long, seller_id long")
    adf = spark.createDataFrame(auctions, AUCTION)
    got = replay_bids(adf, items, spark.createDataFrame(attempts, ATTEMPT), W).collect()
    expected, _ = sequential(auctions, sellers, attempts, W)
    assert len(got) == len(attempts)
    assert {r.id: (r.outcome, r.price_after, None if r.end_after is None else millis(r.end_after),
                   r.extended) for r in got} == expected
    seen = {r.outcome for r in got}
    assert seen == {"ACCEPTED", "INVALID_AMOUNT", "NOT_FOUND", "CLOSED", "OWN_ITEM", "BELOW_START",
                    "TOO_LOW"}
    assert any(r.extended for r in got)


def test_all_rising_bids_on_one_auction(spark, hot):
    """Every attempt changes the state, so each piece depends on the one before."""
    auctions = [(1, 1, 1, 1, at(60_000), "open", 0)]
    attempts = [(i, 1, 2 + i % 2, float(i), at(i * 1_000)) for i in range(1, 300)]
    attempts += [(500, 1, 2, 1000.0, at(299_000 + W)), (501, 1, 2, 1001.0, at(299_000 + W + 1))]
    items = spark.createDataFrame([(1, 9)], "id long, seller_id long")
    got = replay_bids(spark.createDataFrame(auctions, AUCTION), items,
                      spark.createDataFrame(attempts, ATTEMPT), W).collect()
    expected, _ = sequential(auctions, {1: 9}, attempts, W)
    assert {r.id: r.outcome for r in got} == {k: v[0] for k, v in expected.items()}
    assert sum(r.outcome == "ACCEPTED" for r in got) == 299


def test_prices_rise_and_auctions_follow(spark):
    auctions, sellers, attempts = random_market(5)
    adf = spark.createDataFrame(auctions, AUCTION)
    items = spark.createDataFrame(list(sellers.items()), "id long, seller_id long")
    taken = accepted(replay_bids(adf, items, spark.createDataFrame(attempts, ATTEMPT), W))
    rows = sorted(taken.collect(), key=lambda r: (r.auction_id, r.created_at, r.id))
    for a, b in zip(rows, rows[1:]):
        if a.auction_id == b.auction_id:
            assert a.amount < b.amount and a.end_after <= b.end_after
    _, state = sequential(auctions, sellers, attempts, W)
    for r in apply_bids(adf, taken).collect():
        assert (r.current_price, millis(r.end_time)) == (state[r.id]["price"], state[r.id]["end"])


def test_one_shuffle_of_the_attempts(spark):
    """Join and windows share the partitioning by auction."""
    auctions, sellers, attempts = random_market(1)
    items = spark.createDataFrame(list(sellers.items()), "id long, seller_id long")
    df = replay_bids(spark.createDataFrame(auctions, AUCTION), items,
                     spark.createDataFrame(attempts, ATTEMPT).repartition(3).where(F.col("id") > 0), W)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    window_side = plan.split("Window")[-1]
    assert plan.count("Window [") == 2
    assert window_side.count("hashpartitioning(auction_id") <= 2  # attempts and auctions, once each
    assert "Python" not in plan


@pytest.mark.parametrize("seed,window,extension", [
    (4, W, W // 4), (5, W, 3 * W), (6, 4 * W, W), (7, 30_000, 90_000), (8, W, W - 1), (9, W, 1), (10, 0, W)])
def test_an_extension_of_its_own(spark, hot, throttle_path, seed, window, extension):
    """Shorter and longer than the window; hot auctions cut, and their bids followed by jumps."""
    auctions, sellers, attempts = random_market(seed, n_auctions=25, n_attempts=700)
    items = spark.createDataFrame(list(sellers.items()), "id long, seller_id long")
    adf = spark.createDataFrame(auctions, AUCTION)
    got = replay_bids(adf, items, spark.createDataFrame(attempts, ATTEMPT), window, extension)
    expected, state = sequential(auctions, sellers, attempts, window, extension)
    assert {r.id: (r.outcome, r.price_after, None if r.end_after is None else millis(r.end_after),
                   r.extended) for r in got.collect()} == expected
    ends = {r.id: millis(r.end_time) for r in apply_bids(adf, accepted(got)).collect()}
    assert ends == {a: s["end"] for a, s in state.items()}
