"""Online login lockout: one small state per ip and address."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gavel.operators.throttle import MAX_FAILURES, WINDOW_MS
from gavel.streaming.bids import LATENESS

ATTEMPT_SCHEMA = """id long, ip string, email string, success boolean, created_at timestamp,
    outcome string"""


class ThrottleProcessor(StatefulProcessor):
    """Counts failures in the window anchored at the first one.

    An attempt at or before the last one judged is OUT_OF_ORDER and counts for nothing.

    The state is dropped by a timer when its window is over, so only keys with a
    recent attempt take space.
    """

    def __init__(self, max_failures: int, window_ms: int):
        self.max_failures = max_failures
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "window", "failures long, until long, last_t long, last_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = failures, until, *last = self.state.get() or (0, 0, -1, -1)
        last = tuple(last)
        for row in sorted(rows, key=lambda r: (r.t, r.id)):
            alive = until > row.t
            if (row.t, row.id) <= last:
                outcome = "OUT_OF_ORDER"
            elif alive and failures >= self.max_failures:
                outcome = "LOCKED"
            elif row.success:
                outcome, failures, until = "SUCCESS", 0, 0
            else:
                outcome = "FAILED"
                failures, until = (failures + 1, until) if alive else (1, row.t + self.window_ms)
            last = max(last, (row.t, row.id))
            yield Row(id=row.id, ip=row.ip, email=row.email, success=row.success,
                      created_at=row.created_at, outcome=outcome)
        if (failures, until, *last) == tuple(before):
            return
        # Once the watermark has passed the window and the last attempt, none can come late.
        if before[2] >= 0:
            self.handle.deleteTimer(max(before[1], before[2] + 1))
        self.state.update((failures, until, *last))
        self.handle.registerTimer(max(until, last[0] + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_throttle(attempts: DataFrame, max_failures: int = MAX_FAILURES,
                    window_ms: int = WINDOW_MS, lateness: str = LATENESS) -> DataFrame:
    """Outcome of every login attempt of a stream; nulls count as in the batch replay."""
    success = F.coalesce("success", F.lit(False))
    rows = attempts.withWatermark("created_at", lateness).select(
        "id", "ip", "email", success.alias("success"), "created_at",
        F.unix_millis("created_at").alias("t"))
    untimed = rows.where(F.col("t").isNull()).drop("t").withColumn(
        "outcome", F.lit("INVALID_ATTEMPT"))
    return untimed.unionByName(rows.where(F.col("t").isNotNull()).groupBy("ip", "email").transformWithState(
        ThrottleProcessor(max_failures, window_ms), ATTEMPT_SCHEMA, "Append", "EventTime"))
