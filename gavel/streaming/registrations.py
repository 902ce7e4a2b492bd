"""Live registration: taken addresses as state, ids in blocks per micro-batch.

The state holds the addresses that are taken, dealt to buckets by their hash, as a key of
its own would cost each address several calls between Python and the state store. It
starts from the stored users, so no micro-batch joins or reads them again. Forms that are refused by their own values meet no
Python worker and no state. An id is the last one given before the micro-batch plus the
form's place in it, and the last one given is kept as a mark per micro-batch: a micro-batch
that is run again finds the same mark and gives the same ids.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gavel.functions.clock import as_of_column
from gavel.operators.ingest import max_id, with_next_ids
from gavel.operators.validate import judge_registrations
from gavel.schemas import USERS, empty
from gavel.sources.versions import _folder
from gavel.streaming.bids import bucket
from gavel.streaming.runtime import prepare_state_store

FORM_SCHEMA = """feed_id long, email string, first_name string, last_name string, phone string,
    role string, outcome string, first_error string"""
_FORM = ["feed_id", "email", "first_name", "last_name", "phone", "role"]


class EmailProcessor(StatefulProcessor):
    """Gives each address of a bucket to its first form, in order of feed id within a micro-batch (forms
    without one last), and refuses all others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "emails array<string>")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.taken.update((initialState.emails,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = (self.taken.get() or ([],))[0]
        taken = set(known)
        for row in sorted(rows, key=lambda r: (r.feed_id is None, r.feed_id or 0, r.text)):
            yield Row(**{c: row[c] for c in _FORM}, first_error=None,
                      outcome="TAKEN" if row.email in taken else "REGISTERED")
            taken.add(row.email)
        if len(taken) > len(known):
            self.taken.update((sorted(taken),))

    def close(self) -> None:
        pass


def stream_registrations(feed: DataFrame, users: DataFrame) -> DataFrame:
    """What became of every form of a stream; see ``FORM_SCHEMA``.

    REGISTERED, TAKEN, or INVALID with the error that the form shows.
    """
    judged = judge_registrations(feed)
    columns = [F.col("feed_id"), F.col("n_email").alias("email"), F.col("n_first").alias("first_name"),
               F.col("n_last").alias("last_name"), F.col("n_phone").alias("phone"),
               F.col("n_role").alias("role")]
    invalid = judged.where(F.size("errors") > 0).select(
        *columns, F.lit("INVALID").alias("outcome"), F.col("errors")[0].alias("first_error"))
    valid = judged.where(F.size("errors") == 0).select(*columns).withColumns({
        "key": bucket("email"), "text": F.to_json(F.struct(*_FORM))})
    known = users.select(F.lower("email").alias("email")).groupBy(bucket("email").alias("key")).agg(
        F.collect_set("email").alias("emails"))
    settled = valid.groupBy("key").transformWithState(
        EmailProcessor(), FORM_SCHEMA, "Append", "None", initialState=known.groupBy("key"))
    return settled.unionByName(invalid)


def _marks(spark: SparkSession, home: str) -> dict[int, int]:
    """Last id given by each micro-batch that still has a mark."""
    fs, at = _folder(spark, f"{home}/marks")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {int(batch): int(last) for batch, last in (n.split("_") for n in names)}


def _mark(spark: SparkSession, home: str, batch_id: int, last_id: int) -> None:
    # The numbers are in the name, so a mark is there whole or not at all.
    fs, at = _folder(spark, f"{home}/marks/{batch_id}_{last_id}")
    fs.create(at, True).close()


def number_batch(batch: DataFrame, batch_id: int, home: str, as_of: Column | str) -> None:
    """Store the outcomes of one micro-batch and the users it makes, with their ids.

    Running it again replaces its own folders with the same rows.
    """
    spark = batch.sparkSession
    # Written first and read back: the state is updated by one pass over the micro-batch.
    batch.write.mode("overwrite").parquet(f"{home}/forms/batch_id={batch_id}")
    forms = spark.read.schema(FORM_SCHEMA).parquet(f"{home}/forms/batch_id={batch_id}")
    new = forms.where("outcome = 'REGISTERED'")
    marks = _marks(spark, home)
    previous = max(b for b in marks if b < batch_id)
    numbered(new, marks[previous], as_of).write.mode("overwrite").parquet(f"{home}/users/batch_id={batch_id}")
    _mark(spark, home, batch_id, marks[previous] + new.count())
    for older in (b for b in marks if b < previous):
        fs, at = _folder(spark, f"{home}/marks/{older}_{marks[older]}")
        fs.delete(at, False)


def numbered(new: DataFrame, after: int, as_of: Column | str) -> DataFrame:
    """User rows for registered forms, numbered from ``after`` + 1 by feed id and address."""
    order = F.struct(F.col("feed_id").isNull().alias("none"), "feed_id", "email")
    rows = with_next_ids(new.withColumn("_order", order), "_order", after)
    return rows.withColumn("created_at", as_of_column(as_of)).select(*USERS.fieldNames())


def run_registrations(feed: DataFrame, users: DataFrame, home: str, as_of: Column | str) -> DataFrame:
    """Process all forms available and return the users registered so far.

    ``home``, a folder all executors share, holds state, marks and rows; a run with the
    same ``home`` continues where the last one ended, whatever ``users`` has got since.
    One stream at a time gives ids. Outcomes of forms are in ``home``/forms.
    """
    spark = feed.sparkSession
    prepare_state_store(spark)
    if not _marks(spark, home):
        _mark(spark, home, -1, max_id(users))
    query = (stream_registrations(feed, users).writeStream.outputMode("append")
             .foreachBatch(lambda batch, batch_id: number_batch(batch, batch_id, home, as_of))
             .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return registered(spark, home)


def registered(spark: SparkSession, home: str) -> DataFrame:
    """The users registered so far below ``home``."""
    fs, at = _folder(spark, f"{home}/users")
    if not fs.exists(at):
        return empty(spark, USERS)
    return spark.read.schema(USERS).parquet(f"{home}/users").select(*USERS.fieldNames())


def outcomes(spark: SparkSession, home: str) -> DataFrame:
    """What became of every form so far below ``home``; see ``FORM_SCHEMA``."""
    return spark.read.schema(FORM_SCHEMA).parquet(f"{home}/forms").select(
        *_FORM, "outcome", "first_error")
