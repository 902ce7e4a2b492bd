"""Login throttle replay: which login attempts were refused unread.

Per ip and address, a failure opens a window that stays anchored at it. Once
``max_failures`` failures fall into the window, everything until its end is
LOCKED and not recorded. A success that is let through clears the window.

Keys with up to ``FOLD_ROWS`` attempts, normally all of them, are folded in one
pass over their sorted attempts. An attacked key may hold a third of all
attempts, so larger keys are never gathered. There, every failure that could
anchor a window has one successor: the failure that would anchor the next one.
The anchors really used are those reachable from a key's first failure, found by
pointer jumping: in each round the known anchors add the ones their jump leads
to, and every jump doubles its length. Rounds grow with the logarithm of the
number of windows, and each is an equi-join on (key, failure number), which
spreads even one key over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.ordered import History, history, running
from gavel.session import shared_dir

MAX_FAILURES = 10
WINDOW_MS = 15 * 60 * 1000
FOLD_ROWS = 10_000
FOLD_ROWS_CONF = "spark.gavel.foldRows"


def _successors(hist: History, max_failures: int, window_ms: int) -> DataFrame:
    """Per failure: its number ``n`` in the key, ``locks_t``/``locks_id`` of the
    failure that fills its window (null when none does) and ``next_n``."""
    key = list(hist.keys)
    failures = hist.df.where(~F.col("success")).select(*key, "t", "id", "n", "run")
    # The failure that would fill the window: in the same run, so no success
    # that was let through lies between.
    full = failures.select(*key, "run", (F.col("n") - (max_failures - 1)).alias("n"),
                           F.col("t").alias("full_t"), F.col("id").alias("full_id"))
    # The first success after a run of failures, and the failures up to it.
    cleared = hist.df.where(F.col("success") & (F.col("n") > F.col("run"))).select(
        *key, "run", F.col("t").alias("clear_t"), F.col("n").alias("clear_n"))
    # The number of failures before the end of the window: count them on a
    # history of the failures and the window ends, ends first among equals.
    marks = failures.select(*key, "id", "n", F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("t") + window_ms).alias("t")),
        F.struct(F.lit(1).alias("kind"), F.col("t").alias("t")))))
    expiry = running(history(marks, key, ["t", "kind", "id"]),
                     {"expiry_n": ("sum", F.col("kind"))}).df.where("kind = 0").select(
        *key, "n", F.col("expiry_n").cast("long"))

    locks = F.col("full_t") < F.col("t") + window_ms
    clears = F.col("clear_t") < F.col("t") + window_ms
    return (failures.join(full, [*key, "run", "n"], "left")
            .join(cleared, [*key, "run"], "left")
            .join(expiry, [*key, "n"])
            .select(*key, "n", "t", "id",
                    F.when(locks, F.col("full_t")).alias("locks_t"),
                    F.when(locks, F.col("full_id")).alias("locks_id"),
                    F.when(locks, F.col("expiry_n"))
                    .when(clears, F.col("clear_n")).otherwise(F.col("expiry_n"))
                    .alias("next_n")))


def reachable(successors: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of the rows that ``successors`` (key, n, next_n) lead to from the ``first``
    ones, these included, by pointer jumping."""
    # The last jump of a key leads past its last row, where nothing joins.
    jump = successors.select(*key, "n", "next_n")
    reached = first.select(*key, "n").checkpoint()
    while not jump.isEmpty():
        # Both joins are on (key, row number), which no two rows share.
        onward = jump.select(*key, F.col("n").alias("next_n"), F.col("next_n").alias("far_n"))
        reached = reached.unionByName(
            reached.join(jump, [*key, "n"]).select(*key, F.col("next_n").alias("n"))).checkpoint()
        jump = jump.join(onward, [*key, "next_n"]).select(
            *key, "n", F.col("far_n").alias("next_n")).checkpoint()
    return reached


def _fold(rows: DataFrame, max_failures: int, window_ms: int) -> DataFrame:
    """Attempts with ``locked``, for keys of bounded size."""
    def count(value: int) -> Column:
        return F.lit(value).cast("long")

    empty_locks = F.array().cast("array<struct<t:bigint,id:bigint,until:bigint>>")
    start = F.struct(count(0).alias("n"), count(0).alias("until"), empty_locks.alias("locks"))

    def step(state: Column, row: Column) -> Column:
        alive = state["until"] > row["t"]
        locked = alive & (state["n"] >= max_failures)
        n = (F.when(locked, state["n"]).when(row["success"], count(0))
             .when(alive, state["n"] + 1).otherwise(count(1)))
        until = (F.when(locked, state["until"]).when(row["success"], count(0))
                 .when(alive, state["until"]).otherwise(row["t"] + window_ms))
        fills = ~locked & (n == max_failures)
        lock = F.struct(row["t"].alias("t"), row["id"].alias("id"), until.alias("until"))
        return F.struct(n.alias("n"), until.alias("until"), F.when(
            fills, F.concat(state["locks"], F.array(lock))).otherwise(state["locks"]).alias("locks"))

    def judged(row: Column, locks: Column) -> Column:
        after = F.exists(locks, lambda lock: (row["t"] < lock["until"]) & (
            (row["t"] > lock["t"]) | ((row["t"] == lock["t"]) & (row["id"] > lock["id"]))))
        return row.withField("locked", after)

    grouped = rows.groupBy("ip", "email").agg(F.sort_array(F.collect_list(
        F.struct("t", "id", "success", "created_at"))).alias("rows"))
    folded = grouped.withColumn("locks", F.aggregate(
        "rows", start, step, lambda state: state["locks"]))
    return folded.select("ip", "email", F.inline(F.transform(
        "rows", lambda row: judged(row, F.col("locks"))))).select(
        "id", "ip", "email", "success", "created_at", "locked")


def _jump(rows: DataFrame, max_failures: int, window_ms: int) -> DataFrame:
    """Attempts with ``locked``, for keys of any size."""
    key = ["ip", "email"]
    hist = history(rows, key, ["t", "id"])
    # n: failures before the row; run: failures before its run of failures began.
    hist = running(hist, {"n": ("sum", (~F.col("success")).cast("long"))})
    hist = running(hist, {"run": ("max", F.when(F.col("success"), F.col("n")))})
    hist = hist.map(lambda df: df.withColumn("run", F.coalesce("run", F.lit(0))).checkpoint())
    successors = _successors(hist, max_failures, window_ms).checkpoint()

    # Locked: after the filling failure and before the end of its window. The
    # windows used do not overlap, so the latest one that filled decides.
    filled = (successors.where(F.col("locks_t").isNotNull())
              .join(reachable(successors, successors.where("n = 0"), key), [*key, "n"])
              .select(*key, F.col("locks_id").alias("id"),
                      (F.col("t") + window_ms).alias("until")))
    latest = running(hist.map(lambda df: df.join(filled, [*key, "id"], "left")),
                     {"latest": ("max", F.col("until"))})
    return latest.df.select("id", "ip", "email", "success", "created_at",
                            F.coalesce(F.col("t") < F.col("latest"), F.lit(False)).alias("locked"))


def replay_login_throttle(attempts: DataFrame, max_failures: int = MAX_FAILURES,
                          window_ms: int = WINDOW_MS) -> DataFrame:
    """Attempts with ``outcome`` LOCKED, FAILED or SUCCESS.

    A null ``success`` is a failure and comes back as false. A null ip or email is a
    key like any other. An attempt without a time is INVALID_ATTEMPT and counts for
    nothing.
    """
    key = ["ip", "email"]
    every = attempts.select("id", "ip", "email",
                            F.coalesce("success", F.lit(False)).alias("success"), "created_at")
    untimed = every.where(F.col("created_at").isNull()).withColumn(
        "outcome", F.lit("INVALID_ATTEMPT"))
    # Keys without nulls, so that equi-joins find them all.
    rows = every.where(F.col("created_at").isNotNull()).withColumns(
        {k: F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")) for k in key}
        | {"t": F.unix_millis("created_at")})
    fold_rows = int(attempts.sparkSession.conf.get(FOLD_ROWS_CONF, str(FOLD_ROWS)))
    shared_dir(attempts.sparkSession)
    large = (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
             .where(F.col("_rows") > fold_rows).select(*key).checkpoint())
    if large.isEmpty():
        judged = _fold(rows, max_failures, window_ms)
    else:
        judged = _fold(rows.join(large, key, "left_anti"), max_failures, window_ms).unionByName(
            _jump(rows.join(large, key, "left_semi"), max_failures, window_ms))
    judged = judged.withColumns({k: F.when(F.col(k) != "", F.substr(k, F.lit(2))) for k in key})
    return untimed.unionByName(judged.select(
        "id", "ip", "email", "success", "created_at",
        F.when(F.col("locked"), "LOCKED").when(F.col("success"), "SUCCESS")
        .otherwise("FAILED").alias("outcome")))
