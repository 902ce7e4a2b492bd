"""Versions of a stored market: whole changes or none, and only touched files written again."""

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import at

from gavel import schemas
from gavel.operators.erase import erase_cascade
from gavel.plans import stored
from gavel.plans.snapshot import market_snapshot
from gavel.sources import versions
from gavel.sources.tables import Tables

MINUTE, HOUR = 60_000, 3_600_000
NOW = at(10 * HOUR)
FILE_ROWS = 20


@pytest.fixture(scope="module")
def market(spark) -> Tables:
    """200 auctions of 100 users; the first 50 end by ``NOW``."""
    users = [(u, "F", "L", f"{u}@x.test", "1", "seller" if u <= 20 else "buyer", at(0))
             for u in range(1, 101)]
    items = [(i, 1 + (i - 1) // 10, f"T{i}", "", "Art", "", at(0)) for i in range(1, 201)]
    auctions = [(i, i, 100, 100, at(0), at(5 * HOUR if i <= 50 else 100 * HOUR + i), "open", None, at(0))
                for i in range(1, 201)]
    return Tables(spark.createDataFrame(users, schemas.USERS), spark.createDataFrame(items, schemas.ITEMS),
                  spark.createDataFrame(auctions, schemas.AUCTIONS), schemas.empty(spark, schemas.BIDS),
                  schemas.empty(spark, schemas.TRANSACTIONS))


@pytest.fixture(scope="module")
def attempts(spark):
    pick = random.Random(4)
    rows = [(n, pick.randint(1, 60), pick.randint(21, 100), float(pick.randint(50, 900)),
             at(MINUTE * n // 2)) for n in range(1, 500)]
    return spark.createDataFrame(rows, schemas.BID_ATTEMPTS)


def rows_of(tables: Tables):
    return {name: sorted(map(repr, df.collect())) for name, df in tables.items_by_name().items()}


def test_changes_equal_those_of_plain_tables(spark, market, attempts, tmp_path):
    path = str(tmp_path)
    first = versions.create(market, path, FILE_ROWS)
    assert first.number == 1 and len(first.files["auctions"]) > 5 and first.files["bids"] == ()
    stored.apply_attempts(spark, path, attempts, file_rows=FILE_ROWS)
    closed = stored.settle_due(spark, path, NOW, FILE_ROWS)
    assert closed.number == 3
    plain = market_snapshot(market, attempts, NOW)
    assert rows_of(closed.tables(spark)) == rows_of(plain)
    # The version before is still as it was, and nothing more is due.
    assert rows_of(first.tables(spark)) == rows_of(market)
    assert stored.settle_due(spark, path, NOW, FILE_ROWS).number == 3
    # Auctions that end later lie in other files, which stay.
    late = {f for f in first.files["auctions"]
            if not first.read(spark, "auctions", [f]).where(F.col("id") <= 60).count()}
    assert late and late <= set(closed.files["auctions"])

    gone = spark.createDataFrame([(3,)], "id long")
    erased = stored.erase_users(spark, path, gone, FILE_ROWS)
    assert rows_of(erased.tables(spark)) == rows_of(erase_cascade(plain, gone))
    for table in ("users", "items", "auctions", "transactions"):
        kept = set(erased.files[table]) & set(closed.files[table])
        assert 2 * len(kept) > len(closed.files[table]), table
    assert stored.erase_users(spark, path, gone, FILE_ROWS).number == erased.number
    assert rows_of(versions.compact(spark, path, FILE_ROWS).tables(spark)) == rows_of(
        erased.tables(spark))


def test_a_crash_between_two_tables_changes_nothing(spark, market, attempts, tmp_path, monkeypatch):
    path = str(tmp_path)
    versions.create(market, path, FILE_ROWS)
    write = stored.write_files

    def lost(df, path, table, file_rows):
        if table == "bids":
            raise OSError("lost")
        return write(df, path, table, file_rows)

    monkeypatch.setattr(stored, "write_files", lost)
    with pytest.raises(OSError):
        stored.apply_attempts(spark, path, attempts, file_rows=FILE_ROWS)
    monkeypatch.undo()
    assert rows_of(versions.latest(spark, path).tables(spark)) == rows_of(market)
    # The batch is simply applied again.
    again = stored.apply_attempts(spark, path, attempts, file_rows=FILE_ROWS)
    assert again.number == 2 and again.read(spark, "bids").count() > 100


def test_the_second_of_two_writers_is_refused(spark, market, tmp_path):
    path = str(tmp_path)
    first = versions.create(market, path, FILE_ROWS)
    versions.commit(spark, first, users=first.files["users"][:1])
    with pytest.raises(versions.VersionTaken):
        versions.commit(spark, first, users=())
    now = versions.latest(spark, path)
    assert now.number == 2 and now.files["users"] == first.files["users"][:1]


def test_many_keys_are_joined(spark, market, tmp_path, monkeypatch):
    first = versions.create(market, str(tmp_path), FILE_ROWS)
    ids = spark.createDataFrame([(1,), (2,), (None,), (9_999,)], "id long")
    few = first.files_with(spark, "items", {"seller_id": ids})
    monkeypatch.setattr(versions, "LITERAL_KEYS", 1)
    assert first.files_with(spark, "items", {"seller_id": ids}) == few and len(few) <= 2


def test_no_market_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.latest(spark, str(tmp_path))


def test_a_tick_opens_only_what_may_be_due(spark, market, tmp_path):
    """Ticks through the whole schedule: later and closed auctions are never opened."""
    spread = market.auctions.withColumn("end_time", F.timestamp_millis(
        F.unix_millis("start_time") + F.col("id") * 20 * MINUTE))
    plain = Tables(market.users, market.items, spread, market.bids, market.transactions)
    path, one = f"{tmp_path}/ticks", f"{tmp_path}/one"
    versions.create(plain, path, FILE_ROWS)
    versions.create(plain, one, FILE_ROWS)
    for hours in (-1, 0, 7, 7.5, 30, 80):
        before = versions.latest(spark, path)
        now = at(hours * HOUR)
        may_be_due = before.files_ending_by(int(now.timestamp() * 1000))
        left = before.read(spark, "auctions", set(before.files["auctions"]) - set(may_be_due))
        assert not left.where((F.col("status") == "open") & (F.col("end_time") <= F.lit(now))).count()
        if may_be_due:
            shelves = before.read(spark, "auctions", may_be_due)
            assert not shelves.where("status <> 'open'").count()
            assert not shelves.where(F.unix_millis("end_time") > int(now.timestamp() * 1000) + HOUR).count()
        after = stored.settle_due(spark, path, now, FILE_ROWS)
        assert (after.number == before.number) == (hours <= 0)
        assert set(before.files["auctions"]) - set(may_be_due) <= set(after.files["auctions"])
    at_once = stored.settle_due(spark, one, at(80 * HOUR), FILE_ROWS)
    assert rows_of(after.tables(spark)) == rows_of(at_once.tables(spark))
    assert after.read(spark, "auctions").where("status = 'closed'").count() == 200


def test_an_extended_auction_moves_to_its_new_hour(spark, market, tmp_path):
    path = str(tmp_path)
    versions.create(market, path, FILE_ROWS)
    end = 5 * HOUR
    late = spark.createDataFrame([(1, 7, 30, 500.0, at(end - 1_000))], schemas.BID_ATTEMPTS)
    base = stored.apply_attempts(spark, path, late, window_ms=HOUR, extension_ms=2 * HOUR,
                                 file_rows=FILE_ROWS)
    due = base.files_ending_by(int(at(end + MINUTE).timestamp() * 1000))
    assert 7 not in {r.id for r in base.read(spark, "auctions", due).collect()}
    closed = stored.settle_due(spark, path, at(end + MINUTE), FILE_ROWS).read(spark, "auctions")
    assert closed.where("status = 'closed'").count() == 49
    assert stored.settle_due(spark, path, at(8 * HOUR), FILE_ROWS).read(spark, "transactions").count() == 1


def test_files_without_a_folder_by_end_are_always_opened(spark):
    old = versions.Version("", 1, {"auctions": (
        "data/auctions/a/part-0", "data/auctions/b/shelf=open3600000/part-0",
        "data/auctions/b/shelf=open-3600000/part-0", "data/auctions/b/shelf=rest/part-0")})
    assert old.files_ending_by(0) == ["data/auctions/a/part-0", "data/auctions/b/shelf=open-3600000/part-0"]
