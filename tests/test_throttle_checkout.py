import numpy as np
import pytest
from tests.conftest import at, millis

from gavel.operators.checkout import apply_payments, replay_checkout
from gavel.operators.ordered import HOT_ROWS_CONF
from gavel.operators.throttle import replay_login_throttle

LOGIN = "id long, ip string, email string, success boolean, created_at timestamp"


def sequential(attempts, limit, window):
    entries, out = {}, {}
    for id_, ip, email, success, ts in sorted(attempts, key=lambda r: (r[4], r[0])):
        now, key = millis(ts), (ip, email)
        entry = entries.get(key)
        if entry and entry[1] > now and entry[0] >= limit:
            out[id_] = "LOCKED"
        elif success:
            entries.pop(key, None)
            out[id_] = "SUCCESS"
        else:
            entries[key] = (1, now + window) if not entry or entry[1] <= now else (entry[0] + 1, entry[1])
            out[id_] = "FAILED"
    return out


def attack(seed, n=900):
    """One key under constant attack among others, with instants that repeat."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.5 else int(rng.integers(1, 12))
        rows.append((i + 1, "10.0.0.1", f"u{user}@x", bool(rng.random() < (0.1 if user == 0 else 0.3)),
                     at(int(rng.integers(0, 600)) * 50)))
    return rows


@pytest.mark.parametrize("limit,window", [(3, 1_000), (10, 4_000), (2, 50), (1, 500)])
def test_throttle_matches_the_counter_kept_one_by_one(spark, hot, throttle_path, limit, window):
    rows = attack(limit)
    got = replay_login_throttle(spark.createDataFrame(rows, LOGIN), limit, window).collect()
    assert {r.id: r.outcome for r in got} == sequential(rows, limit, window)
    assert len(got) == len(rows)
    assert "LOCKED" in {r.outcome for r in got}


def test_window_is_anchored_and_ends_inclusively(spark, throttle_path):
    # Ten failures lock until exactly 15 minutes after the first one.
    rows = [(i, "a", "b", False, at(i * 1_000)) for i in range(10)]
    rows += [(20, "a", "b", True, at(899_999)), (21, "a", "b", True, at(900_000)),
             (22, "a", "b", False, at(900_001))]
    got = {r.id: r.outcome for r in
           replay_login_throttle(spark.createDataFrame(rows, LOGIN)).collect()}
    assert got[9] == "FAILED" and got[20] == "LOCKED"
    assert got[21] == "SUCCESS" and got[22] == "FAILED"


TXN = "id long, auction_id long, buyer_id long, seller_id long, amount long, status string, created_at timestamp"
PAY = "id long, auction_id long, buyer_id long, created_at timestamp"


def test_checkout_outcomes_in_order(spark):
    txns = spark.createDataFrame([(1, 1, 10, 5, 100, "pending", at(1_000)),
                                  (2, 2, 11, 5, 100, "paid", at(0)),
                                  (3, 3, 12, 5, 100, "pending", at(0))], TXN)
    attempts = spark.createDataFrame([
        (1, 9, 10, at(5_000)),   # no invoice
        (2, 1, 10, at(999)),     # invoice not written yet
        (3, 1, 99, at(2_000)),   # not the winner
        (4, 1, 10, at(3_000)),   # pays
        (5, 1, 10, at(3_000)),   # same instant, later id
        (6, 1, 99, at(4_000)),   # not the winner is told before already paid
        (7, 2, 11, at(1_000)),   # paid before
        (8, 3, 12, at(0)),       # at the very instant of the invoice
    ], PAY)
    replayed = replay_checkout(txns, attempts)
    assert {r.id: r.outcome for r in replayed.collect()} == {
        1: "NOT_FOUND", 2: "NOT_FOUND", 3: "NOT_WINNER", 4: "PAID", 5: "ALREADY_PAID",
        6: "NOT_WINNER", 7: "ALREADY_PAID", 8: "PAID"}
    assert {r.id: r.status for r in apply_payments(txns, replayed).collect()} == {
        1: "paid", 2: "paid", 3: "paid"}


def test_checkout_matches_payments_taken_one_by_one(spark, hot):
    rng = np.random.default_rng(4)
    invoices = {a: (int(rng.integers(1, 4)), int(rng.integers(0, 50))) for a in range(1, 8)}
    rows = [(i, int(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8])), int(rng.integers(1, 4)),
             at(rng.integers(0, 100))) for i in range(400)]
    paid, expected = set(), {}
    for id_, auction, buyer, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        winner, since = invoices.get(auction, (None, None))
        if winner is None or millis(ts) < since:
            expected[id_] = "NOT_FOUND"
        elif buyer != winner:
            expected[id_] = "NOT_WINNER"
        elif auction in paid:
            expected[id_] = "ALREADY_PAID"
        else:
            expected[id_] = "PAID"
            paid.add(auction)
    txns = spark.createDataFrame([(a, a, b, 0, 10, "pending", at(s))
                                  for a, (b, s) in invoices.items()], TXN)
    got = replay_checkout(txns, spark.createDataFrame(rows, PAY)).collect()
    assert {r.id: r.outcome for r in got} == expected


def test_rows_of_a_hot_auction_are_not_shuffled(spark):
    """They meet their one invoice as a broadcast, with the same outcomes."""
    txns = spark.createDataFrame([(a, a, 1, 0, 10, "pending", at(0)) for a in range(50)], TXN)
    rows = [(i, 7 if i % 2 else i % 50, 1 + i % 3, at(i)) for i in range(5_000)]
    rows += [(i, None, 1, at(i)) for i in range(5_000, 5_100)]
    attempts = spark.createDataFrame(rows, PAY)
    plain = {r.id: r.outcome for r in replay_checkout(txns, attempts).collect()}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", HOT_ROWS_CONF: "1000"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        replayed = replay_checkout(txns, attempts)
        plan = replayed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [auction_id" in plan and "LeftAnti" in plan
        assert {r.id: r.outcome for r in replayed.collect()} == plain
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert sorted(plain) == list(range(5_100))
    assert sum(o == "PAID" for o in plain.values()) == 26
    assert all(plain[i] == "NOT_FOUND" for i in range(5_000, 5_100))


def test_nulls_count_alike_on_both_paths(spark, throttle_path, hot):
    rows = [(i, None if k == 0 else "ip", None if k == 1 else "m", None if i % 2 else False, at(i))
            for k in range(3) for i in range(k * 100, k * 100 + 20)]
    rows.append((999, "ip", "m", True, None))
    got = replay_login_throttle(spark.createDataFrame(rows, LOGIN), 3, 1_000_000).collect()
    outcomes = {r.id: r.outcome for r in got}
    assert outcomes.pop(999) == "INVALID_ATTEMPT"
    assert outcomes == {i: "FAILED" if i % 100 < 3 else "LOCKED" for i, *_ in rows[:-1]}
    assert {(r.ip, r.email, r.success) for r in got if r.id != 999} == {
        (None, "m", False), ("ip", None, False), ("ip", "m", False)}
