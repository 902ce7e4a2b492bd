"""Live bid acceptance and closing as a stateful stream.

The state of an auction is its price, end, leader and listing, and its highest bids, of
which a bounded number is kept. The auctions are dealt by a hash of their id to a fixed
number of buckets, and a bucket is what the stream is keyed by: a key costs several calls
between Python and the state store, and an auction of its own would pay them all. A
micro-batch brings the new attempts of a bucket together, which are judged per auction in
(time, id) order; the size of a micro-batch is set at the source (``maxFilesPerTrigger``,
``maxBytesPerTrigger``) and bounds what one auction can bring at once. What its watchers
are told follows from the state alone, so no micro-batch reads an earlier one again. An
event-time timer at the first end of a bucket closes the auctions whose end the watermark
has passed; all that then stays of one is its number, by which late bids are still CLOSED.
(Spark's own state TTL goes by the clock of the cluster and isn't to be had with
event-time timers.)
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gavel.functions.text import is_long
from gavel.operators.replay import ANTI_SNIPE_MS, accepted as accepted_bids, apply_bids, refused_at_once
from gavel.operators.settle import bid_counts, settle_auctions, winning_bids
from gavel.plans.views import auction_detail, auction_page
from gavel.sources.tables import Tables, scan_tables

LATENESS = "10 minutes"

#: Highest bids that an auction's state keeps.
HISTORY_BIDS = 50

#: Keys of a stateful stream. A checkpoint holds for one number only.
BUCKETS = 4096

_LISTING = ["item_id", "seller_id", "starting_price", "start_ms"]
# kind 'bid': one row per attempt. kind 'closed': one row per auction that ended. kind
# 'state': one row per auction and micro-batch that brought it bids, with the highest of
# all its bids, the best first.
UPDATE_SCHEMA = """kind string, auction_id long, id long, bidder_id long, amount long,
    created_at timestamp, outcome string, price_after long, end_after timestamp,
    extended boolean, bid_count long, item_id long, seller_id long, starting_price long,
    start_time timestamp,
    history array<struct<id:bigint,amount:bigint,created_at:timestamp,bidder_id:bigint>>"""
_BID_FIELDS = ["id", "amount", "t", "bidder_id"]
_BIDS = "array<struct<id:bigint,amount:bigint,t:bigint,bidder_id:bigint>>"
_AUCTION = """auction_id:bigint,price:bigint,end_ms:bigint,leader:bigint,bid_count:bigint,
    last_t:bigint,last_id:bigint,item_id:bigint,seller_id:bigint,starting_price:bigint,
    start_ms:bigint"""


def bucket(*key: str) -> Column:
    """The bucket of a key; the same for every stream, restart and table."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS))


def _timestamp(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(milliseconds=ms)


def _update(kind: str, auction_id: int, **values) -> Row:
    names = ["id", "bidder_id", "amount", "created_at", "outcome", "price_after", "end_after", "extended",
             "bid_count", "item_id", "seller_id", "starting_price", "start_time", "history"]
    return Row(kind=kind, auction_id=auction_id, **{n: values.get(n) for n in names})


class AuctionProcessor(StatefulProcessor):
    """Judges attempts per auction and closes the auctions of a bucket at their ends.

    An attempt at or before the last one judged is OUT_OF_ORDER: taking it would
    change results already published.
    """

    def __init__(self, window_ms: int, extension_ms: int):
        self.window_ms, self.extension_ms = window_ms, extension_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"timer long, auctions array<struct<{_AUCTION}>>")
        self.history = handle.getValueState("history", f"auctions array<struct<auction_id:bigint,bids:{_BIDS}>>")
        self.ended = handle.getValueState("ended", "auction_ids array<long>")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        auctions, histories, ended = {}, {}, []
        for start in initialState.auctions:
            if not start["is_open"]:
                ended.append(start["auction_id"])
                continue
            auctions[start["auction_id"]] = (start["price"], start["end_ms"], start["leader"], start["bid_count"],
                                             -1, -1, *[start[c] for c in _LISTING])
            if start["history"]:
                # Accepted bids rise, so the last ones are the highest.
                histories[start["auction_id"]] = [
                    tuple(b[c] for c in _BID_FIELDS) for b in reversed(start["history"])]
        if ended:
            self.ended.update((ended,))
        if histories:
            self._keep_histories(histories)
        self._keep(auctions, None)

    def _opened(self) -> tuple[dict, int | None]:
        """The open auctions of the bucket and its timer."""
        timer, auctions = self.open.get() or (None, [])
        return {auction_id: tuple(state) for auction_id, *state in auctions}, timer

    def _histories(self) -> dict[int, list[tuple]]:
        """The highest bids of the open auctions that have any."""
        return {auction_id: [tuple(b) for b in bids] for auction_id, bids in (self.history.get() or ([],))[0]}

    def _keep_histories(self, histories: dict[int, list[tuple]]) -> None:
        if histories:
            self.history.update((list(histories.items()),))
        else:
            self.history.clear()

    def _ended(self) -> list[int]:
        return list((self.ended.get() or ([],))[0])

    def _keep(self, auctions: dict, timer: int | None, expired: bool = False) -> None:
        """Store the open auctions, with a timer at the first end."""
        first = min((state[1] for state in auctions.values()), default=None)
        if first != timer:
            # An expired timer is gone without being deleted.
            if timer is not None and not expired:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if auctions:
            self.open.update((first, [(auction_id, *state) for auction_id, state in auctions.items()]))
        elif timer is not None:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        auctions, timer = self._opened()
        histories = ended = None
        changed = False
        # A listing counts from its own time on; the auction's first row is its listing.
        in_order = sorted(rows, key=lambda r: (r.auction_id, r.t, not r.listed, r.id))
        for auction_id, mine in groupby(in_order, key=lambda r: r.auction_id):
            state = auctions.get(auction_id)
            if state is None and ended is None:
                ended = set(self._ended())
            taken = []
            state, moved = yield from self._judge(mine, state, state is None and auction_id in ended, taken)
            if state is None:
                continue
            auctions[auction_id], changed = state, True
            if taken:
                if histories is None:
                    histories = self._histories()
                kept = histories[auction_id] = [*histories.get(auction_id, []), *taken][-HISTORY_BIDS:]
                price, end, leader, bids, _, _, *listing = state
                yield self._seen("state", auction_id, price, end, leader, bids, listing, extended=moved, history=[
                    (i, amount, _timestamp(t), bidder) for i, amount, t, bidder in reversed(kept)])
        if histories is not None:
            self._keep_histories(histories)
        if changed:
            self._keep(auctions, timer)

    def _judge(self, rows: Iterator[Row], state, closed: bool, taken: list[tuple]):
        """Outcomes of one auction's rows; adds the accepted bids to ``taken`` and returns the
        state after them and whether the end moved."""
        moved = False
        if state is not None:
            price, end, leader, bids, last_t, last_id, *listing = state
        for row in rows:
            if row.listed:
                if state is None and not closed:
                    price, end, leader, bids, last_t, last_id = None, row.end_ms, None, 0, -1, -1
                    listing = [row[c] for c in _LISTING]
                    state = ()
                continue
            if state is None:
                yield self._judged(row, "CLOSED" if closed else "NOT_FOUND", 0)
                continue
            outcome, extended = "ACCEPTED", False
            if (row.t, row.id) <= (last_t, last_id):
                outcome = "OUT_OF_ORDER"
            elif row.t >= end:
                outcome = "CLOSED"
            elif row.bidder_id == listing[1]:
                outcome = "OWN_ITEM"
            elif price is None and row.amount < listing[2]:
                outcome = "BELOW_START"
            elif price is not None and row.amount <= price:
                outcome = "TOO_LOW"
            if outcome == "ACCEPTED":
                extended = end - row.t <= self.window_ms
                price, leader, bids = row.amount, row.bidder_id, bids + 1
                end = row.t + self.extension_ms if extended else end
                moved = moved or extended
                taken.append((row.id, row.amount, row.t, row.bidder_id))
            last_t, last_id = max((last_t, last_id), (row.t, row.id))
            yield self._judged(row, outcome, bids, end if outcome == "ACCEPTED" else None, extended)
        if state is not None:
            state = (price, end, leader, bids, last_t, last_id, *listing)
        return state, moved

    def _judged(self, row: Row, outcome: str, bids: int, end: int | None = None,
                extended: bool = False) -> Row:
        taken = end is not None
        return _update("bid", row.auction_id, id=row.id, bidder_id=row.bidder_id, amount=row.amount,
                       created_at=row.created_at, outcome=outcome,
                       price_after=row.amount if taken else None,
                       end_after=_timestamp(end) if taken else None, extended=extended, bid_count=bids)

    def _seen(self, kind: str, auction_id: int, price, end, leader, bids, listing, **values) -> Row:
        item, seller, start, start_ms = listing
        return _update(kind, auction_id, bidder_id=leader, amount=price, created_at=_timestamp(end),
                       price_after=price, end_after=_timestamp(end), bid_count=bids, item_id=item,
                       seller_id=seller, starting_price=start,
                       start_time=None if start_ms is None else _timestamp(start_ms), **values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        auctions, timer = self._opened()
        # All ends whose own timers would have expired by now.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        due = [auction_id for auction_id, state in auctions.items() if state[1] <= passed]
        for auction_id in due:
            price, end, leader, bids, _, _, *listing = auctions.pop(auction_id)
            yield self._seen("closed", auction_id, price, end, leader, bids, listing, extended=False,
                             outcome="SOLD" if bids else "UNSOLD")
        self.ended.update(([*self._ended(), *due],))
        if self.history.exists():
            self._keep_histories({a: bids for a, bids in self._histories().items() if a in auctions})
        self._keep(auctions, timer, expired=True)

    def close(self) -> None:
        pass


def _optional(df: DataFrame, column: str, kind: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def _starting_state(auctions: DataFrame, items: DataFrame, bids: DataFrame | None) -> DataFrame:
    """Per auction: end, whether it is open, its listing, and price, leader, number and
    highest of its bids."""
    start = auctions.join(items.select(F.col("id").alias("item_id"), "seller_id"), "item_id").select(
        F.col("id").alias("auction_id"), F.unix_millis("end_time").alias("end_ms"),
        (F.col("status") == "open").alias("is_open"), "item_id", "seller_id", "starting_price",
        F.unix_millis(_optional(auctions, "start_time", "timestamp")).alias("start_ms"))
    if bids is None:
        return start.select("*", F.lit(None).cast("long").alias("price"),
                            F.lit(None).cast("long").alias("leader"),
                            F.lit(0).cast("long").alias("bid_count"),
                            F.lit(None).cast(_BIDS).alias("history"))
    top = winning_bids(bids).select("auction_id", F.col("amount").alias("price"),
                                    F.col("bidder_id").alias("leader"))
    highest = Window.partitionBy("auction_id").orderBy(F.desc("amount"), F.desc("id"))
    history = (bids.withColumn("_nth", F.row_number().over(highest)).where(F.col("_nth") <= HISTORY_BIDS)
               .groupBy("auction_id").agg(F.sort_array(F.collect_list(F.struct(
                   "_nth", "id", "amount", F.unix_millis("created_at").alias("t"), "bidder_id"))).alias("history"))
               .withColumn("history", F.transform("history", lambda b: b.dropFields("_nth"))))
    return (start.join(top, "auction_id", "left").join(bid_counts(bids), "auction_id", "left")
            .join(history, "auction_id", "left").fillna(0, ["bid_count"]))


def stream_updates(attempts: DataFrame, auctions: DataFrame, items: DataFrame,
                   window_ms: int = ANTI_SNIPE_MS, lateness: str = LATENESS,
                   bids: DataFrame | None = None, listings: DataFrame | None = None,
                   extension_ms: int | None = None) -> DataFrame:
    """Bid outcomes and closings for a stream of attempts; see ``UPDATE_SCHEMA``.

    Every auction starts in the state, so those without a bid are closed too, and no
    table is joined in again for each micro-batch. ``bids`` are those accepted before
    the stream, from which it continues. ``listings`` is a second stream (id, seller_id,
    starting_price, end_time, created_at, and item_id if documents or invoices need it) of
    auctions that open while this one runs; one is found by attempts from its
    ``created_at`` on. The watermark is that of both streams together, so a quiet one
    doesn't hold it back. A late bid leaves ``extension_ms``, the window if not given.
    """
    refusal = refused_at_once()
    # Refused without any state, so these rows meet no Python worker.
    refused = attempts.where(refusal.isNotNull()).select(
        F.lit("bid").alias("kind"), "auction_id", "id", "bidder_id",
        F.when(is_long(F.col("amount").cast("double")), F.col("amount").try_cast("long")).alias("amount"),
        "created_at", refusal.alias("outcome"), F.lit(False).alias("extended"),
        F.lit(0).cast("long").alias("bid_count"))
    nothing = F.lit(None).cast("long")
    rows = attempts.where(refusal.isNull()).select(
        bucket("auction_id").alias("key"), "auction_id", "id", "bidder_id",
        F.col("amount").try_cast("long").alias("amount"), "created_at",
        F.lit(False).alias("listed"), nothing.alias("end_ms"),
        *[nothing.alias(c) for c in _LISTING])
    if listings is not None:
        rows = rows.unionByName(listings.where("id is not null and created_at is not null").select(
            bucket("id").alias("key"), F.col("id").alias("auction_id"), "id",
            nothing.alias("bidder_id"), nothing.alias("amount"), "created_at",
            F.lit(True).alias("listed"), F.unix_millis("end_time").alias("end_ms"),
            _optional(listings, "item_id", "long").alias("item_id"), "seller_id", "starting_price",
            F.unix_millis("created_at").alias("start_ms")))
    rows = rows.withWatermark("created_at", lateness).withColumn("t", F.unix_millis("created_at"))
    start = _starting_state(auctions, items, bids)
    initial = start.groupBy(bucket("auction_id").alias("key")).agg(
        F.collect_list(F.struct(*start.columns)).alias("auctions"))
    judged = rows.groupBy("key").transformWithState(
        AuctionProcessor(window_ms, window_ms if extension_ms is None else extension_ms), UPDATE_SCHEMA, "Append", "EventTime",
        initialState=initial.groupBy("key"))
    return judged.unionByName(refused, allowMissingColumns=True)


def bid_outcomes(updates: DataFrame) -> DataFrame:
    """The bid side of the updates, with the columns of the batch replay."""
    return updates.where(F.col("kind") == "bid").select(
        "id", "auction_id", "bidder_id", "amount", "created_at", "outcome", "price_after",
        "end_after", "extended")


def accepted_updates(updates: DataFrame) -> DataFrame:
    return updates.where((F.col("kind") == "bid") & (F.col("outcome") == "ACCEPTED"))


def closings(updates: DataFrame) -> DataFrame:
    """The closing side: (auction_id, end_time, winner_id, amount, bid_count)."""
    return closed_updates(updates).select(
        "auction_id", F.col("end_after").alias("end_time"), F.col("bidder_id").alias("winner_id"),
        "amount", "bid_count")


def closed_updates(updates: DataFrame) -> DataFrame:
    """Closings with all that the state knew of the auction."""
    return updates.where(F.col("kind") == "closed")


def price_ticks(accepted: DataFrame) -> DataFrame:
    """Price and bid count of an auction after each bid it took, earlier ones included."""
    return accepted.select(F.col("auction_id").alias("auctionId"),
                           F.col("price_after").alias("currentPrice"),
                           F.col("bid_count").alias("bidCount"))


def closed_ticks(closed: DataFrame) -> DataFrame:
    """What everybody in the market is told of a closed auction."""
    return closed.select(F.lit("closed").alias("type"), F.col("auction_id").alias("auctionId"))


def closing_invoices(updates: DataFrame) -> DataFrame:
    """The pending transaction of each auction that closed with a winner, also of those
    listed while the stream ran: the seller comes with the closing."""
    sold = closed_updates(updates).where(F.col("bidder_id").isNotNull())
    return sold.select(
        F.col("auction_id").alias("id"), "auction_id", F.col("bidder_id").alias("buyer_id"),
        "seller_id", "amount", F.lit("pending").alias("status"), F.col("end_after").alias("created_at"))


def close_due(spark: SparkSession, home: str, as_of: Column | str) -> Tables:
    """One tick of the settlement as a job of its own, for markets without a bid
    stream: reads the snapshot in ``home`` and returns the next one."""
    t = scan_tables(spark, home)
    auctions, invoices = settle_auctions(t.auctions, t.items, t.bids, t.transactions, as_of)
    return replace(t, auctions=auctions, transactions=t.transactions.unionByName(invoices))


def market_after(t: Tables, updates: DataFrame) -> Tables:
    """The market ``t`` after all updates of a stream so far."""
    taken = accepted_bids(bid_outcomes(updates))
    closed = closings(updates).select(
        F.col("auction_id").alias("id"), F.lit("closed").alias("_status"),
        F.col("winner_id").alias("_winner"))
    auctions = apply_bids(t.auctions, taken).join(closed, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "winner_id": F.coalesce("_winner", "winner_id")})
    bids = t.bids.unionByName(taken.drop("end_after"))
    return replace(t, bids=bids, auctions=auctions.select(*t.auctions.columns))


def _auctions_seen(seen: DataFrame, status: str) -> DataFrame:
    """Auctions as the updates of one micro-batch leave them."""
    return seen.select(
        F.col("auction_id").alias("id"), "item_id", "starting_price",
        F.coalesce("amount", "starting_price").alias("current_price"), "start_time",
        F.col("end_after").alias("end_time"), F.lit(status).alias("status"),
        (F.col("bidder_id") if status == "closed" else F.lit(None).cast("long")).alias("winner_id"),
        F.col("start_time").alias("created_at"))


def _counted(document: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents with the number of all bids, of which the state keeps only some."""
    counts = seen.select(F.col("auction_id").alias("auctionId"), F.col("bid_count").alias("_bids"))
    return document.join(counts, "auctionId").withColumn(
        "auction", F.col("auction").withField("bidCount", F.col("_bids"))).drop("_bids")


def bid_documents(batch: DataFrame, t: Tables, as_of: Column | str) -> DataFrame:
    """What the watchers of each auction with new bids are sent: the auction, its
    highest bids and whether the end moved.

    All of it is in the ``state`` rows of the micro-batch; ``t`` gives the texts of items
    and the names of users, also of those that came after the stream began.
    """
    rows = batch.where(F.col("kind") == "state")
    latest = rows.groupBy("auction_id").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in ("auction_id", "extended")]), "bid_count").alias("s"),
        F.max("extended").alias("extended")).select("auction_id", "extended", "s.*")
    bids = latest.select("auction_id", F.inline("history"))
    page = auction_page(replace(t, auctions=_auctions_seen(latest, "open"), bids=bids,
                                transactions=t.transactions.where("false")), as_of)
    moved = latest.select(F.col("auction_id").alias("auctionId"), "extended")
    return _counted(page, latest).join(moved, "auctionId").select(
        F.lit("bid").alias("type"), "auctionId", "auction", "bids", "extended")


def closed_documents(batch: DataFrame, t: Tables, as_of: Column | str) -> DataFrame:
    """What the watchers of each auction closed in a micro-batch are sent."""
    closed = closed_updates(batch)
    nothing = t.bids.where("false")  # the closings carry the number of bids
    detail = auction_detail(replace(t, auctions=_auctions_seen(closed, "closed"), bids=nothing), as_of)
    document = detail.select("auctionId", F.struct(*detail.columns).alias("auction"))
    return _counted(document, closed).select(F.lit("closed").alias("type"), "auctionId", "auction")
