import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavel.operators import ordered
from gavel.operators.ingest import with_next_ids
from gavel.operators.ordered import (HOT_ROWS_CONF, PIECE, attach, history, lookup, packed, place,
                                     position, running)


def _rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    # One key holds most rows; times repeat, so the id breaks ties.
    return pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, 7, rng.integers(0, 30, n)),
        "t": rng.integers(0, 40, n), "id": rng.permutation(n),
        "v": np.where(rng.random(n) < 0.2, np.nan, rng.integers(-50, 50, n))})


def _expected(rows, inclusive):
    out = {}
    for _, group in rows.sort_values(["k", "t", "id"]).groupby("k"):
        seen = []
        for r in group.itertuples():
            if inclusive and not np.isnan(r.v):
                seen.append(int(r.v))
            out[r.id] = (sum(seen), max(seen, default=None), min(seen, default=None))
            if not inclusive and not np.isnan(r.v):
                seen.append(int(r.v))
    return out


def test_running_values_match_a_sequential_pass(spark, hot):
    rows = _rows()
    df = spark.createDataFrame(rows).select(
        "k", "t", "id", F.when(~F.isnan("v"), F.col("v").cast("long")).alias("v"))
    for inclusive in (False, True):
        hist = history(df, ["k"], ["t", "id"])
        assert bool(hist.pieces) == (hot == "cut")
        got = running(hist, {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")),
                             "lo": ("min", F.col("v"))}, inclusive=inclusive).df.collect()
        assert {r.id: (r.s, r.hi, r.lo) for r in got} == _expected(rows, inclusive)


def test_a_hot_key_is_spread_over_pieces(spark):
    spark.conf.set(HOT_ROWS_CONF, "50")
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("t"), "id")
    sizes = [r["count"] for r in history(df, ["k"], ["t", "id"]).df.groupBy(PIECE).count().collect()]
    spark.conf.unset(HOT_ROWS_CONF)
    assert sum(sizes) == 1000
    assert len(sizes) > 10 and max(sizes) < 150


def test_attach_gives_each_row_its_reference(spark, hot):
    df = spark.createDataFrame(_rows()).select("k", "t", "id")
    reference = spark.range(25).select(F.col("id").alias("k"), (F.col("id") * 10).alias("ref"))
    got = attach(history(df, ["k"], ["t", "id"]), reference).df.collect()
    assert len(got) == 400
    assert all(r.ref == (r.k * 10 if r.k < 25 else None) for r in got)


def test_lookup_joins_hot_and_other_keys_alike(spark, hot):
    df = spark.createDataFrame(_rows()).select("k", "id")
    reference = spark.range(25).select(F.col("id").alias("k"), (F.col("id") * 10).alias("ref"))
    for how in ("left", "inner"):
        got = {r.id: r.ref for r in lookup(df, reference, ["k"], how).collect()}
        assert got == {r.id: r.k * 10 if r.k < 25 else None for r in df.collect()
                       if how == "left" or r.k < 25}


def test_position_counts_within_the_key(spark, hot):
    rows = _rows()
    got = {r.id: r.position for r in
           position(spark.createDataFrame(rows), ["k"], ["t", "id"]).collect()}
    ranked = rows.sort_values(["t", "id"])
    ranked["n"] = ranked.groupby("k").cumcount() + 1
    assert got == dict(zip(ranked["id"], ranked["n"]))


def test_a_hot_key_of_generated_rows_is_cut(spark):
    spark.conf.set(HOT_ROWS_CONF, "50")
    one = spark.createDataFrame([(1,)], "k long")
    df = one.select("k", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("id"))
    assert history(df, ["k"], ["id"]).pieces
    spark.conf.unset(HOT_ROWS_CONF)


def test_a_null_key_is_cut_like_any_other(spark, hot):
    rows = [(None if i % 3 else i % 5, i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long, v long")
    hist = history(df, ["k"], ["id"])
    if hot == "cut":
        sizes = {r[PIECE]: r["count"] for r in
                 hist.df.where("k IS NULL").groupBy(PIECE).count().collect()}
        assert 0 not in sizes and max(sizes.values()) < 100
    got = {r.id: r.s for r in running(hist, {"s": ("sum", F.col("v"))}).df.collect()}
    assert got == {i: sum(v for k2, j, v in rows if k2 == k and j < i) for k, i, _ in rows}


def test_places_in_the_whole_table(spark):
    df = spark.createDataFrame([(i * 7 % 101, str(i)) for i in range(101)], "a long, b string")
    numbered = place(df.repartition(5), ["a"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert sorted((r.a, r.position) for r in numbered.collect()) == [(i, i + 1) for i in range(101)]
    assert place(df.where("false"), ["a"]).collect() == []


def test_packed_numbers_order_like_pairs(spark):
    longs = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    for lows in ([b for b in longs if b >= 0], [b for b in longs if b <= 0]):
        df = spark.createDataFrame([(a, b) for a in longs for b in lows], "a long, b long")
        got = [tuple(r) for r in df.orderBy(packed("a", "b")).collect()]
        assert got == sorted(got)


def test_next_ids_are_dense_in_key_order(spark, hot):
    keys = [3, 999_999, 1_000_000, 5_500_000, 5_500_001, 12] + list(range(100, 200))
    df = spark.createDataFrame([(k,) for k in keys], "feed_id long")
    got = {r.feed_id: r.id for r in with_next_ids(df, "feed_id", 40).collect()}
    assert got == {k: 41 + i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("buckets", [1, 2, 8, 1 << 20])
def test_hot_keys_are_those_of_a_full_count(spark, monkeypatch, buckets):
    """Whatever shares a bucket: no hot key is missed and no other named, nulls included."""
    monkeypatch.setattr(ordered, "BUCKETS", buckets)
    pick = random.Random(buckets)
    sizes = {(k, f"n{k % 3}" if k % 4 else None): pick.choice([1, 7, 15, 16, 17, 40]) for k in range(30)}
    sizes[(None, None)], sizes[(None, "n0")] = 50, 16
    rows = spark.createDataFrame([key for key, n in sizes.items() for _ in range(n)], "k long, n string")
    spark.conf.set(HOT_ROWS_CONF, "16")
    try:
        found = ordered.hot_keys(rows, ["k", "n"])
        assert {(r.k, r.n): r["_rows"] for r in found.collect()} == {
            key: n for key, n in sizes.items() if n > 16}
        few = rows.where("k < 30").dropDuplicates(["k", "n"])
        if buckets > 8:
            assert ordered.hot_keys(few, ["k", "n"]) is None
        assert ordered.hot_keys(few.where("false"), ["k"]) is None
        # Hot together in one bucket, but none by itself.
        if buckets == 1:
            assert ordered.hot_keys(few, ["k", "n"]) is None
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
