import json

import numpy as np
from tests.conftest import at, millis

from gavel.operators.rooms import (current_rooms, parse_subscribe, room_viewers, update_audience,
                                   viewer_sessions)

SUB = "id long, client_id long, ts timestamp, room string"
UPDATE = "id long, auction_id long, ts timestamp"


def test_parse_subscribe_keeps_what_the_socket_would_join(spark):
    cases = [
        ('{"type": "subscribe", "auctionId": 12}', "12"),
        ('{"type": "subscribe", "auctionId": "12"}', "12"),
        ('{"type": "subscribe", "auctionId": " 0x10 "}', "16"),
        ('{"type": "subscribe", "auctionId": 12.0}', "12"),
        ('{"type": "subscribe", "auctionId": -3}', "-3"),
        ('{"type": "subscribe", "auctionId": "all"}', "all"),
        ('{"type": "subscribe", "auctionId": true}', "1"),
        ('{"type": "subscribe", "auctionId": null}', "0"),
        ('{"type": "subscribe", "auctionId": "true"}', None),
        ('{"type": "subscribe", "auctionId": 1.5}', None),
        ('{"type": "subscribe", "auctionId": "ALL"}', None),
        ('{"type": "subscribe"}', None),
        (r'{"type": "\u0073ubscribe", "auctionId": 5}', "5"),
        (r'{"t\u0079pe": "subscribe", "auctionId": 6}', "6"),
        ('{"type": "subscribed", "auctionId": 5}', None),
        ('{"type": "ping", "auctionId": 12}', None),
        ("not json", None), ("", None), (None, None),
    ]
    feed = spark.createDataFrame([(i, i, raw, at(i)) for i, (raw, _) in enumerate(cases)],
                                 "id long, client_id long, raw string, ts timestamp")
    got = {r.id: r.room for r in parse_subscribe(feed).collect()}
    assert got == {i: room for i, (_, room) in enumerate(cases) if room is not None}
    assert json.loads(cases[0][0])["auctionId"] == 12


def _feed(n=600, seed=3):
    rng = np.random.default_rng(seed)
    rooms = ["all", "all", "1", "1", "2", "3", "4"]
    subs = [(i, 1 if rng.random() < 0.4 else int(rng.integers(2, 25)), at(rng.integers(0, 300)),
             rooms[rng.integers(0, len(rooms))]) for i in range(n)]
    updates = [(i, int(rng.integers(1, 7)), at(rng.integers(0, 320))) for i in range(200)]
    return subs, updates


def test_update_audience_matches_delivery_one_by_one(spark, hot):
    subs, updates = _feed()
    steps = sorted([(millis(ts), 0, i, (c, room)) for i, c, ts, room in subs]
                   + [(millis(ts), 1, i, a) for i, a, ts in updates], key=lambda s: s[:3])
    where, expected = {}, {}
    for _, kind, i, what in steps:
        if kind == 0:
            where[what[0]] = what[1]
        else:
            rooms = list(where.values())
            expected[i] = (rooms.count(str(what)), rooms.count("all"))
    got = update_audience(spark.createDataFrame(subs, SUB),
                          spark.createDataFrame(updates, UPDATE)).collect()
    assert {r.id: (r.room_clients, r.all_clients) for r in got} == expected


def test_rooms_hold_each_client_once(spark):
    subs, _ = _feed()
    last = {}
    for i, client, ts, room in sorted(subs, key=lambda s: (s[2], s[0])):
        last[client] = room
    df = spark.createDataFrame(subs, SUB)
    assert {r.client_id: r.room for r in current_rooms(df).collect()} == last
    counts = {r.room: r.viewers for r in room_viewers(df).collect()}
    assert counts == {room: list(last.values()).count(room) for room in set(last.values())}


def test_sessions_end_after_the_gap(spark, hot):
    rows = [(i, 1, at(t)) for i, t in enumerate([0, 10_000, 40_000, 70_001, 100_002])]
    rows += [(10 + i, 2, at(i * 1_000)) for i in range(60)]
    got = viewer_sessions(spark.createDataFrame(rows, "id long, client_id long, ts timestamp"),
                          30_000).collect()
    assert sorted((r.client_id, millis(r.session_start), millis(r.session_end), r.signals)
                  for r in got) == [
        (1, 0, 40_000, 3), (1, 70_001, 70_001, 1), (1, 100_002, 100_002, 1), (2, 0, 59_000, 60)]


def test_subscriptions_are_read_as_json(spark):
    raw = {1: '{"type":"subscribe","x":{"auctionId":true},"auctionId":7}', 2: '{"type":"subscribe","auctionId":1e300}',
           3: '{"x":{"type":"subscribe"},"auctionId":7}', 4: '{"type":"subscribe","auctionId":"all"}',
           5: '{"type":"subscribe","auctionId":true}', 6: '{"type":"subscribe","auctionId":"0x1F"}',
           7: '{"type":"subscribe","auctionId":null}', 8: '{"type":"subscribe"}', 9: "[1", 10: None,
           11: '{"type":"subscribe","auctionId":{"a":1}}', 12: '{"type":"subscribe","auctionId":2.5}',
           13: '{"type":"subscribe","auctionId":"0x' + "F" * 40 + '"}'}
    feed = spark.createDataFrame([(i, 1, r, at(i)) for i, r in raw.items()],
                                 "id long, client_id long, raw string, ts timestamp")
    got = {r.id: r.room for r in parse_subscribe(feed).collect()}
    assert got == {1: "7", 4: "all", 5: "1", 6: "31", 7: "0"}
