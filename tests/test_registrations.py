"""Live registration: one account per address, ids unique across batches, runs and retries."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import at

from gavel import schemas
from gavel.operators.ingest import ingest_users
from gavel.operators.validate import validate_registrations
from gavel.streaming import registrations as live
from gavel.streaming.runtime import read_stream

NOW = "2024-01-20T00:00:00+00:00"


def form(feed_id, email, first="F", password="long-enough"):
    return (feed_id, first, "L", email, "1", password, password, None)


@pytest.fixture(scope="module")
def users(spark):
    rows = [(u, "F", "L", f"{u}@X.test", "1", "buyer", at(0)) for u in (3, 8, 40)]
    return spark.createDataFrame(rows, schemas.USERS)


def arrive(spark, path, forms):
    spark.createDataFrame(forms, schemas.REGISTRATION_FEED).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, users):
    feed = read_stream(spark, f"{tmp_path}/in", schemas.REGISTRATION_FEED, files_per_trigger=1)
    new = live.run_registrations(feed, users, f"{tmp_path}/home", NOW)
    forms = spark.read.schema(live.FORM_SCHEMA).parquet(f"{tmp_path}/home/forms")
    outcomes = {r.feed_id: r.outcome for r in forms.collect()}
    return {r.email: r.id for r in new.collect()}, outcomes


def test_an_address_registers_once_within_and_across_batches(spark, tmp_path, users):
    path = f"{tmp_path}/in"
    arrive(spark, path, [form(2, " A@x.test "), form(1, "a@x.test"), form(3, "8@x.TEST"),
                         form(4, "bad"), form(5, "b@x.test")])
    arrive(spark, path, [form(6, "A@x.test"), form(7, "c@x.test"), form(8, "c@x.test", password="no")])
    new, outcomes = run(spark, tmp_path, users)
    assert new == {"a@x.test": 41, "b@x.test": 42, "c@x.test": 43}
    assert outcomes == {1: "REGISTERED", 2: "TAKEN", 3: "TAKEN", 4: "INVALID", 5: "REGISTERED",
                        6: "TAKEN", 7: "REGISTERED", 8: "INVALID"}

    # The next run continues from the marks, also if the new users are stored by now.
    stored = users.unionByName(spark.createDataFrame(
        [(99, "F", "L", "z@x.test", "1", "buyer", at(0))], schemas.USERS))
    arrive(spark, path, [form(9, "b@X.test"), form(11, "e@x.test"), form(10, "d@x.test")])
    new, outcomes = run(spark, tmp_path, stored)
    assert new == {"a@x.test": 41, "b@x.test": 42, "c@x.test": 43, "d@x.test": 44, "e@x.test": 45}
    assert (outcomes[9], outcomes[10]) == ("TAKEN", "REGISTERED")
    assert run(spark, tmp_path, stored)[0] == new  # nothing new


def test_a_batch_run_again_gives_the_same_ids(spark, tmp_path):
    def rows(*emails):
        return spark.createDataFrame(
            [(n, e, "F", "L", "1", "buyer", "REGISTERED", None) for n, e in enumerate(emails)],
            live.FORM_SCHEMA)

    home = str(tmp_path)
    live._mark(spark, home, -1, 10)
    live.number_batch(rows("a", "b"), 0, home, NOW)
    live.number_batch(rows("c"), 1, home, NOW)
    live.number_batch(rows("d", "e"), 2, home, NOW)

    def ids():
        return {r.email: r.id for r in spark.read.schema(schemas.USERS).parquet(f"{home}/users").collect()}

    once = ids()
    assert once == {"a": 11, "b": 12, "c": 13, "d": 14, "e": 15}
    # Lost after its rows, before or after its mark was written.
    live.number_batch(rows("d", "e"), 2, home, NOW)
    assert ids() == once
    fs, mark = live._folder(spark, f"{home}/marks/2_15")
    fs.delete(mark, False)
    live.number_batch(rows("d", "e"), 2, home, NOW)
    assert ids() == once
    assert sorted(live._marks(spark, home)) == [1, 2]  # older marks are gone
    live.number_batch(rows(), 3, home, NOW)
    assert live._marks(spark, home)[3] == 15


def test_the_stream_equals_the_batch(spark, tmp_path, users):
    forms = [form(n, f"{n * 7 % 23}@x.test", first="" if n % 5 == 0 else f"F{n}") for n in range(1, 60)]
    for start in range(0, 60, 15):
        arrive(spark, f"{tmp_path}/in", forms[start:start + 15])
    got, _ = run(spark, tmp_path, users)
    valid, _ = validate_registrations(spark.createDataFrame(forms, schemas.REGISTRATION_FEED))
    expected = {r.email: r.id for r in ingest_users(users, valid, NOW).collect()}
    assert got == expected


def test_forms_without_number_and_without_any_value(spark, tmp_path, users):
    path = f"{tmp_path}/in"
    arrive(spark, path, [form(None, "n@x.test", "One"), form(5, "n@x.test"), form(None, "m@x.test"),
                         (None,) * 8])
    new, _ = run(spark, tmp_path, users)
    assert new == {"n@x.test": 41, "m@x.test": 42}
    forms = spark.read.schema(live.FORM_SCHEMA).parquet(f"{tmp_path}/home/forms")
    assert {r.outcome: r.n for r in forms.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {
        "REGISTERED": 2, "TAKEN": 1, "INVALID": 1}


def test_addresses_share_the_keys_of_the_state(spark, tmp_path, users, monkeypatch):
    """Keys don't grow with the addresses, of stored users or new ones."""
    from gavel.streaming import bids

    monkeypatch.setattr(bids, "BUCKETS", 2)
    arrive(spark, f"{tmp_path}/in", [form(n, f"{n % 25}{'@x.test' if n % 2 else '@X.test'}") for n in range(1, 40)])
    new, outcomes = run(spark, tmp_path, users)
    state = spark.read.format("statestore").option("stateVarName", "taken").load(f"{tmp_path}/home/checkpoint")
    assert state.count() <= 2
    emails = {e for r in state.collect() for e in r["value"]["emails"]}
    assert set(new) <= emails and {r.email.lower() for r in users.collect()} <= emails
    valid, _ = validate_registrations(spark.createDataFrame(
        [form(n, f"{n % 25}@x.test") for n in range(1, 40)], schemas.REGISTRATION_FEED))
    assert new == {r.email: r.id for r in ingest_users(users, valid, NOW).collect()}
    assert sorted(outcomes.values()).count("REGISTERED") == len(new)
