import pytest
from pyspark.sql import functions as F
from tests.conftest import at

from gavel.functions import clock, labels, money, text
from gavel.functions.text import coerce_id, safe_image_url, to_number


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_money_groups_digits_the_indian_way(spark):
    cases = {1200000: "₹12,00,000", 680000: "₹6,80,000", 540000: "₹5,40,000", 1000000: "₹10,00,000",
             0: "₹0", 7: "₹7", 999: "₹999", 1000: "₹1,000", 99999: "₹99,999", 100000: "₹1,00,000",
             123456789012: "₹1,23,45,67,89,012", None: "₹0", -123456: "₹-1,23,456"}
    assert column(spark, list(cases), "long", money.money_inr) == list(cases.values())


@pytest.mark.parametrize("ms,shown", [
    (0, "Ended"), (-1, "Ended"), (None, "Ended"), (1, "00:00:00"), (999, "00:00:00"), (1_000, "00:00:01"),
    (86_399_999, "23:59:59"), (86_400_000, "1d 00:00:00"), (106_800_000, "1d 05:40:00")])
def test_time_left(spark, ms, shown):
    end = None if ms is None else at(ms)
    assert column(spark, [end], "timestamp",
                  lambda c: clock.time_left(c, clock.as_of_column(at(0)))) == [shown]


@pytest.mark.parametrize("ms,shown", [
    (-5_000, "just now"), (59_999, "just now"), (60_000, "1m ago"), (3_599_999, "59m ago"),
    (3_600_000, "1h ago"), (86_399_999, "23h ago"), (86_400_000, "1d ago"), (10 * 86_400_000, "10d ago")])
def test_time_ago(spark, ms, shown):
    assert column(spark, [at(0)], "timestamp",
                  lambda c: clock.time_ago(c, clock.as_of_column(at(ms)))) == [shown]


def test_iso_keeps_milliseconds(spark):
    assert column(spark, [at(500), at(86_400_000)], "timestamp", clock.iso_utc) == [
        "2024-01-01T00:00:00.500Z", "2024-01-02T00:00:00.000Z"]


def test_only_zoned_times_parse(spark):
    cases = {"2024-01-01T00:00:00Z": 0, "2024-01-01T05:30+05:30": 0, "2024-01-01T00:00:00.123456Z": 123,
             "2024-01-01T00:00Z": 0, "2024-01-01T00:00:00": None, "2024-01-01": 0, "2024-02-31": None,
             "2024-13-01T00:00:00Z": None, "tomorrow": None, "": None}
    got = column(spark, list(cases), "string", lambda c: clock.iso_utc(clock.parse_zoned(c)))
    expected = [None if v is None else f"2024-01-01T00:00:00.{v:03d}Z" for v in cases.values()]
    assert got == expected


def test_numbers_follow_the_form_language(spark):
    cases = {"": 0.0, "  ": 0.0, None: 0.0, "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "1.5": 1.5, ".5": 0.5,
             "5.": 5.0, "+7": 7.0, "-7": -7.0, "0x10": 16.0, "0XfF": 255.0, "0b101": 5.0, "0o17": 15.0,
             "12px": None, "1d": None, "1f": None, "NaN": None, "1,000": None, "0x": None, "--1": None,
             "Infinity": None, "12\n": 12.0}
    assert column(spark, list(cases), "string", text.to_number) == list(cases.values())


def test_ids_are_positive_whole_numbers(spark):
    cases = {"1": 1, "1e2": 100, "0x10": 16, "": None, "0": None, "-1": None, "1.5": None, "abc": None,
             "2.0": 2, None: None}
    assert column(spark, list(cases), "string", text.coerce_id) == list(cases.values())


def test_trim_and_length_are_unicode_aware(spark):
    padded = " ﻿\t a b 　 \n"
    assert column(spark, [padded, None], "string", text.norm_text) == ["a b", ""]
    assert column(spark, ["é", "😀", "a😀b", ""], "string", text.utf16_length) == [1, 2, 4, 0]
    assert column(spark, [" John@Example.COM "], "string", text.norm_email) == ["john@example.com"]


def test_names(spark):
    df = spark.createDataFrame([("John", "Doe"), (None, None), ("A", "")], "f string, l string")
    rows = df.select(text.full_name(F.col("f"), F.col("l")).alias("full"),
                     text.masked_name(F.col("f"), F.col("l")).alias("masked")).collect()
    assert [tuple(r) for r in rows] == [("John Doe", "John D."), (None, None), ("A ", "A .")]


def test_image_urls(spark):
    cases = {"https://a.example/x.jpg": True, "HTTP://A.EXAMPLE": True, "http:a.example": True,
             "https://user:pw@host:8080/p": True, "javascript:alert(1)": False,
             "data:image/png;base64,AA": False, "/images/x.jpg": False, "https://": False,
             "https://[::1]:443/x": True, "https://a:65536/": False, "https://a:/x": True,
             "https://a:b/": False, "https://a%2/": False, "ftp://a.example": False,
             "https://a b.example/": False, "": False, None: False}
    assert column(spark, list(cases), "string", text.safe_image_url) == list(cases.values())


def test_state_labels(spark):
    df = spark.createDataFrame(
        [(1, "open", None, None, 0, 10, 10), (2, "closed", 5, "paid", 1, 10, 20),
         (3, "closed", 5, "pending", 2, 10, 30), (4, "closed", None, None, 0, 10, 10),
         (5, "cancelled", None, None, 0, 10, 10), (6, None, None, None, 0, None, None)],
        "id int, status string, winner long, pay string, n long, start long, price long")
    c = F.col
    rows = df.orderBy("id").select(
        labels.listing_state(c("status"), c("pay"), c("winner")).alias("listing"),
        labels.win_state(c("pay")).alias("win"), labels.is_unpaid(c("pay")).alias("unpaid"),
        labels.min_next_bid(c("n"), c("start"), c("price")).alias("least"),
        labels.price_label(c("n")).alias("price"), labels.bid_count_label(c("n")).alias("count")).collect()
    assert [r.listing for r in rows] == ["Live", "Sold · Paid", "Sold · Awaiting payment", "Unsold",
                                         "Unsold", "Unsold"]
    assert [r.win for r in rows] == ["Payment due", "Paid"] + ["Payment due"] * 4
    assert [r.unpaid for r in rows] == [True, False, True, True, True, True]
    assert [r["least"] for r in rows][:3] == [10, 21, 31]
    assert [r["count"] for r in rows][:3] == ["0 Bids", "1 Bid", "2 Bids"]
    assert rows[0].price == "Starting Bid" and rows[1].price == "Current Bid"


def test_outcome_notice(spark):
    rows = [("open", True, None, None, 1, None), ("closed", False, 5, "A B.", 5, "paid"),
            ("closed", False, 5, "A B.", 5, "pending"), ("closed", False, 5, "A B.", 6, "paid"),
            ("closed", False, None, None, 6, None), ("cancelled", False, None, None, 6, None),
            ("open", False, None, None, 6, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, s string, b boolean, w long, n string, v long, p string")
    c = F.col
    got = [r.x for r in df.orderBy("i").select(labels.auction_outcome(
        c("b"), c("s"), c("w"), c("n"), c("v"), c("p"), F.lit(120000)).alias("x")).collect()]
    assert got == [
        None, "You won this auction at ₹1,20,000. Payment complete.",
        "Congratulations - you won this auction at ₹1,20,000.",
        "This auction has ended. Won by A B. at ₹1,20,000.",
        "This auction ended with no bids.", "This auction has ended.", "This auction has ended."]


def test_extreme_numbers_end_no_job(spark):
    values = ["0x" + "F" * 22, "0b" + "1" * 70, "0x" + "0" * 40 + "7", "1e400", "0o" + "7" * 400, "0x", "0x0"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        to_number(F.col("v")).alias("n"), coerce_id(F.col("v")).alias("id")).collect()
    assert [r.n for r in rows[:4]] == [float(0xFFFFFFFFFFFFFFFFFFFFFF), float((1 << 70) - 1), 7.0, float("inf")]
    assert [r.id for r in rows] == [None, None, 7, None, None, None, None]
    assert rows[4].n == float("inf") and rows[5].n is None and rows[6].n == 0.0


def test_ports_of_any_length(spark):
    urls = {"http://a.b:0065535/": True, "http://a.b:65536/": False, "http://a.b:" + "9" * 45: False,
            "http://a.b:" + "0" * 45 + "1": True, "http://a.b:": True}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(
        "u", safe_image_url(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == urls
