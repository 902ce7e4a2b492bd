"""Changes of a stored market: each makes one new version and rewrites only files it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.clock import as_of_column
from gavel.functions.labels import is_due
from gavel.operators.erase import _only, erase_cascade
from gavel.operators.replay import ANTI_SNIPE_MS, accepted, apply_bids, replay_bids
from gavel.operators.settle import bid_counts, due_auctions, settle_auctions
from gavel.session import shared_dir
from gavel.sources.tables import Tables
from gavel.sources.versions import FILE_ROWS, Version, commit, latest, write_files


def apply_attempts(spark: SparkSession, path: str, attempts: DataFrame,
                   window_ms: int = ANTI_SNIPE_MS, extension_ms: int | None = None,
                   file_rows: int = FILE_ROWS) -> Version:
    """Judge a batch of attempts against the newest version and store what was accepted.

    Bids are added as files; of the auctions, only files with an auction that got a bid are
    written again. A batch without an accepted bid makes no version.
    """
    base = latest(spark, path)
    shared_dir(spark)
    asked = attempts.select(F.col("auction_id").alias("id")).where("id is not null").distinct()
    auctions = _only(base.read(spark, "auctions"), "id", asked)
    counts = bid_counts(_only(base.read(spark, "bids"), "auction_id", asked))
    counted = auctions.join(counts.withColumnRenamed("auction_id", "id"), "id", "left").fillna(
        0, ["bid_count"])
    taken = accepted(replay_bids(counted, base.read(spark, "items"), attempts, window_ms,
                                 extension_ms)).checkpoint()
    hit = base.files_with(spark, "auctions", {"id": taken.select(F.col("auction_id").alias("id"))})
    if not hit:
        return base
    changed = apply_bids(base.read(spark, "auctions", hit), taken)
    return commit(
        spark, base,
        auctions=base.replaced("auctions", hit, write_files(changed, path, "auctions", file_rows)),
        bids=base.replaced("bids", (), write_files(taken, path, "bids", file_rows)))


def settle_due(spark: SparkSession, path: str, as_of: Column | str,
               file_rows: int = FILE_ROWS) -> Version:
    """Close what is due at ``as_of`` and add the invoices, in one version.

    Only files of open auctions whose hour has come are opened; bids and items are cut to the
    due auctions first. Nothing due makes no version.
    """
    base = latest(spark, path)
    now = as_of_column(as_of)
    at_ms = spark.range(1).select(F.unix_millis(now)).first()[0]
    hit = base.files_where(spark, "auctions", is_due(F.col("status"), F.col("end_time"), now),
                           base.files_ending_by(at_ms))
    if not hit:
        return base
    some = base.read(spark, "auctions", hit)
    due = due_auctions(some, as_of)
    closed, invoices = settle_auctions(
        some, _only(base.read(spark, "items"), "id", due.select(F.col("item_id").alias("id"))),
        _only(base.read(spark, "bids"), "auction_id", due.select("id")),
        base.read(spark, "transactions"), as_of)
    return commit(
        spark, base,
        auctions=base.replaced("auctions", hit, write_files(closed, path, "auctions", file_rows)),
        transactions=base.replaced(
            "transactions", (), write_files(invoices, path, "transactions", file_rows)))


def erase_users(spark: SparkSession, path: str, user_ids: DataFrame,
                file_rows: int = FILE_ROWS) -> Version:
    """Erase users and what depends on them, in one version (``erase_cascade``).

    Only files with a row that goes or changes are written again. Earlier versions still name
    the old files; whoever has to destroy the data removes those.
    """
    base = latest(spark, path)
    shared_dir(spark)
    users = user_ids.select("id").checkpoint()
    items = _only(base.read(spark, "items"), "seller_id", users).select("id").checkpoint()
    auctions = _only(base.read(spark, "auctions"), "item_id", items).select("id").checkpoint()
    touched = {
        "users": {"id": users}, "items": {"seller_id": users},
        "auctions": {"item_id": items, "winner_id": users},
        "bids": {"auction_id": auctions, "bidder_id": users},
        "transactions": {"auction_id": auctions, "buyer_id": users, "seller_id": users}}
    hit = {table: base.files_with(spark, table, keys) for table, keys in touched.items()}
    if not any(hit.values()):
        return base
    some = Tables(**{table: base.read(spark, table, files) for table, files in hit.items()})
    rest = erase_cascade(some, users).items_by_name()
    return commit(spark, base, **{
        table: base.replaced(table, files, write_files(rest[table], path, table, file_rows))
        for table, files in hit.items() if files})
