"""Live rooms as streams: sessions of silent clients, rooms, and audiences of updates.

An audience takes two stateful operators in a row. The first knows the room of each
client and turns a subscription into a step into one room and a step out of another; the
second knows how many clients each room has. Steps made in a micro-batch reach the counters
in the same one.

A room that many watch gets most steps and updates of a micro-batch. So these are first
counted within slices of time, in columns and without state; the counters get one sum per
room and slice, and the slice's updates as bytes, which only get the room's clients before
the slice with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gavel.operators.rooms import ALL_ROOM
from gavel.streaming.bids import LATENESS, bucket

# kind 0: a step into or out of the room. kind 1: an update sent to it.
_STEPS = "room string, ts timestamp, kind int, id long, auction_id long, step int"
_SLICES = "room string, slice long, steps long, updates binary"
_COUNTED = "room string, before long, updates binary"
_REACHED = "id long, auction_id long, room string, clients long, t long"
# An update as five longs: id, auction, time, clients and which of the first three are null.
_FIELDS = 5

#: Microseconds of a slice.
SLICE = 3_600_000_000
#: Updates that a row carries, and rows of a batch.
CARRIED, SENT_ROWS = 1 << 16, 4096


def stream_sessions(signals: DataFrame, gap: str = "30 seconds",
                    lateness: str = LATENESS) -> DataFrame:
    """(client_id, session_start, session_end, signals) of sessions that are over:
    the client was silent for the gap and the watermark has passed it."""
    return (signals.withWatermark("ts", lateness)
            .groupBy("client_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("signals"), F.max("ts").alias("session_end"))
            .select("client_id", F.col("w.start").alias("session_start"), "session_end", "signals"))


def stream_rooms(subscriptions: DataFrame) -> DataFrame:
    """(client_id, room, ts): the room of every client that moved, in update mode."""
    return (subscriptions.groupBy("client_id")
            .agg(F.max(F.struct("ts", "id", "room")).alias("last"))
            .select("client_id", "last.room", "last.ts"))


class RoomMoves(StatefulProcessor):
    """Per client of a bucket: the steps that its subscriptions make between rooms.

    A subscription at or before the last one heard of the client changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "rooms", "clients array<struct<client_id:bigint,room:string,t:bigint,id:bigint>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clients = {client_id: last for client_id, *last in (self.state.get() or ([],))[0]}
        changed = False
        in_order = sorted(rows, key=lambda r: (r.client_id, r.t, r.id))
        for client_id, mine in groupby(in_order, key=lambda r: r.client_id):
            room, *last = clients.get(client_id, (None, None, None))
            for row in mine:
                if last[0] is not None and (row.t, row.id) <= tuple(last):
                    continue
                last, changed = [row.t, row.id], True
                if row.room != room:
                    yield Row(room=row.room, ts=row.ts, kind=0, id=row.id, auction_id=None, step=1)
                    if room is not None:
                        yield Row(room=room, ts=row.ts, kind=0, id=row.id, auction_id=None, step=-1)
                    room = row.room
            clients[client_id] = (room, *last)
        if changed:
            self.state.update(([(client_id, *last) for client_id, last in clients.items()],))

    def close(self) -> None:
        pass


def _longs(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy()


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows cut into runs of bounded size, for each row the updates up to its end."""
    at, done = 0, 0
    while at < len(ends):
        stop = min(at + SENT_ROWS, max(at + 1, int(np.searchsorted(ends, done + CARRIED, side="right"))))
        yield at, stop
        at, done = stop, int(ends[stop - 1])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per room and slice of a partition that holds whole ones: the sum of the steps, and each
    update with the steps of its slice so far. Of things at the same instant steps come first.
    """
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    rooms = pc.dictionary_encode(table["room"], null_encoding="encode").combine_chunks()
    room, never = rooms.indices.to_numpy(), np.iinfo(np.int64).min
    t, kind = _longs(table["t"], never), _longs(table["kind"])
    order = np.lexsort((kind, t, room))
    room, t, sent = room[order], t[order], kind[order] == 1
    part, step = _longs(table["slice"], never)[order], _longs(table["step"])[order]
    first = np.flatnonzero(np.r_[True, (room[1:] != room[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[first, len(t)])
    so_far = np.cumsum(step)
    so_far -= np.repeat(so_far[first] - step[first], sizes)
    nulls = sum(table[c].is_null().to_numpy().astype(np.int64) << k for k, c in enumerate(("id", "auction_id", "t")))
    updates = np.stack([x[sent] for x in (_longs(table["id"])[order], _longs(table["auction_id"])[order],
                                          t, so_far, nulls[order])], axis=1).astype("<i8")
    steps, n = np.add.reduceat(step, first), np.add.reduceat(sent.astype(np.int64), first)
    # A slice of many updates takes several rows, the first of which has its steps.
    takes = np.where((steps != 0) | (n > 0), np.maximum(-(-n // CARRIED), 1), 0)
    of = np.repeat(np.arange(len(first)), takes)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(takes) - takes, takes)
    start = (np.cumsum(n) - n)[of] + nth * CARRIED
    ends = np.minimum(start + CARRIED, np.cumsum(n)[of])
    for at, stop in _runs(ends):
        here = of[at:stop]
        yield pa.RecordBatch.from_arrays(
            [rooms.dictionary.take(pa.array(room[first[here]])), pa.array(part[first[here]]),
             pa.array(np.where(nth[at:stop] == 0, steps[here], 0)),
             pa.array([updates[i:j].tobytes() for i, j in zip(start[at:stop], ends[at:stop])], pa.binary())],
            names=["room", "slice", "steps", "updates"])


class RoomCounts(StatefulProcessor):
    """Per room of a bucket: how many clients it has before each slice of time.

    A step that comes late counts from then on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clients", "rooms array<struct<room:string,clients:bigint>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = dict(tuple(r) for r in (self.state.get() or ([],))[0])
        rooms = dict(before)
        in_order = sorted(rows, key=lambda r: (r.room or "", r.slice))
        for (room, _), mine in groupby(in_order, key=lambda r: (r.room, r.slice)):
            clients = steps = rooms.get(room, 0)
            for row in mine:
                steps += row.steps
                if row.updates:
                    yield Row(room=room, before=clients, updates=row.updates)
            rooms[room] = steps
        # An empty room needs no state.
        rooms = {room: clients for room, clients in rooms.items() if clients}
        if rooms != before:
            self.state.update((list(rooms.items()),))

    def close(self) -> None:
        pass


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per update that the rows carry, with the clients it reaches."""
    for batch in batches:
        carried = batch.column("updates").to_pylist()
        sizes = np.array([len(x) // (8 * _FIELDS) for x in carried], dtype=np.int64)
        before = batch.column("before").to_numpy()
        for at, stop in _runs(np.cumsum(sizes)):
            values = np.frombuffer(b"".join(carried[at:stop]), dtype="<i8").reshape(-1, _FIELDS)
            row = np.repeat(np.arange(at, stop), sizes[at:stop])
            number, auction, t = (pa.array(values[:, k].copy(), mask=values[:, 4] >> k & 1 == 1) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [number, auction, batch.column("room").take(pa.array(row)), pa.array(before[row] + values[:, 3]), t],
                names=["id", "auction_id", "room", "clients", "t"])


def stream_audience(subscriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, auction_id, room, clients, ts): how many clients each update finds in the room of
    its auction and in the room of those who watch everything; see ``audience``.

    ``subscriptions`` (id, client_id, ts, room) and ``updates`` (id, auction_id, ts) are
    streams. As each micro-batch is judged with what had come until then, the result is
    that of the batch operator for feeds that keep their order across micro-batches; two
    sources must therefore be cut at the same instants, or come from one. ``updates`` may be
    those of the bid stream itself. No row is dropped as late. Clients and rooms are keyed by
    buckets, as the auctions of the bid stream are.
    """
    steps = (subscriptions.where("client_id is not null").withColumns({
        "key": bucket("client_id"), "t": F.unix_micros("ts")}).groupBy("key")
             .transformWithState(RoomMoves(), _STEPS, "Append", "None"))
    sent = updates.select(
        F.explode(F.array(F.col("auction_id").cast("string"), F.lit(ALL_ROOM))).alias("room"), "ts",
        F.lit(1).alias("kind"), "id", "auction_id", F.lit(0).alias("step"))
    rows = steps.unionByName(sent).withColumn("t", F.unix_micros("ts")).withColumn(
        "slice", F.col("t") - F.pmod("t", F.lit(SLICE))).drop("ts")
    counted = (rows.repartition("room", "slice").mapInArrow(_sliced, _SLICES)
               .withColumn("key", bucket("room")).groupBy("key")
               .transformWithState(RoomCounts(), _COUNTED, "Append", "None"))
    return counted.mapInArrow(_opened, _REACHED).withColumn("ts", F.timestamp_micros("t")).drop("t")


def audience(reached: DataFrame) -> DataFrame:
    """(id, auction_id, room_clients, all_clients) of the updates of one micro-batch."""
    in_all = F.col("room") == ALL_ROOM
    return reached.groupBy("id", "auction_id").agg(
        F.sum(F.when(~in_all, F.col("clients"))).alias("room_clients"),
        F.sum(F.when(in_all, F.col("clients"))).alias("all_clients"))
