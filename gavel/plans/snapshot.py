"""The market as it stands after replaying requests and settling at an instant."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.clock import as_of_column
from gavel.operators.replay import ANTI_SNIPE_MS, accepted, apply_bids, replay_bids
from gavel.operators.settle import bid_counts, settle_auctions
from gavel.session import shared_dir
from gavel.sources.tables import Tables


def replay_market(tables: Tables, attempts: DataFrame,
                  window_ms: int = ANTI_SNIPE_MS) -> Tables:
    """Tables after all attempts.

    The replay is read for prices, winners and counts. Its accepted rows, a small
    part of the attempts, are checkpointed so that it runs once.
    """
    shared_dir(attempts.sparkSession)
    counted = tables.auctions.join(
        bid_counts(tables.bids).withColumnRenamed("auction_id", "id"), "id", "left").fillna(
        0, ["bid_count"])
    taken = accepted(replay_bids(counted, tables.items, attempts, window_ms)).checkpoint()
    return replace(tables, auctions=apply_bids(tables.auctions, taken),
                   bids=tables.bids.unionByName(taken.drop("end_after")))


def market_snapshot(tables: Tables, attempts: DataFrame, as_of: Column | str,
                    window_ms: int = ANTI_SNIPE_MS) -> Tables:
    """Tables after all attempts up to ``as_of`` and the settlement at ``as_of``."""
    heard = attempts.where(F.col("created_at") <= as_of_column(as_of))
    t = replay_market(tables, heard, window_ms)
    auctions, invoices = settle_auctions(t.auctions, t.items, t.bids, t.transactions, as_of)
    return replace(t, auctions=auctions, transactions=t.transactions.unionByName(invoices))
