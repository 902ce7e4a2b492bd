"""Live rooms: who watches which auction, and how many an update reaches.

A subscription replaces the client's previous one, so a client sits in at most
one room: ``all`` or one auction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import computed_once, is_long, to_number
from gavel.operators.ordered import history, packed, running
from gavel.session import shared_dir

ALL_ROOM = "all"
_ALL_NUMBER = -(1 << 63)


def parse_subscribe(messages: DataFrame) -> DataFrame:
    """Subscriptions in a feed of raw messages: (id, client_id, ts, room).

    Anything that is not JSON, not a subscription, or names neither ``all`` nor a
    whole number is dropped.
    """
    # Without an escape, the type stands in the message as it is; all else needs no parser.
    raw = F.col("raw")
    may_subscribe = raw.contains('"subscribe"') | raw.contains("\\")
    read = computed_once(messages.select("id", "client_id", "ts", "raw").where(may_subscribe),
                         message=F.try_parse_json("raw"))
    read = computed_once(
        read, type=F.try_variant_get("message", "$.type", "string"),
        value=F.try_variant_get("message", "$.auctionId", "variant"))
    read = computed_once(read.where(F.col("type") == "subscribe"),
                         kind=F.schema_of_variant("value"),
                         target=F.try_variant_get("value", "$", "string"))
    # Bare literals convert to numbers, the same words in quotes do not.
    number = (F.when(F.col("kind") == "VOID", F.lit(0.0))
              .when(F.col("kind") == "BOOLEAN", F.when(F.col("target") == "true", 1.0).otherwise(0.0))
              .when(F.col("kind") == "STRING", to_number(F.col("target")))
              .otherwise(F.try_variant_get("value", "$", "double")))
    read = computed_once(read, number=number)
    room = F.when((F.col("kind") == "STRING") & (F.col("target") == ALL_ROOM), ALL_ROOM).when(
        is_long(F.col("number")), F.col("number").try_cast("long").cast("string"))
    return (read.select("id", "client_id", "ts", room.alias("room"))
            .where(F.col("room").isNotNull()))


def current_rooms(subscriptions: DataFrame) -> DataFrame:
    """(client_id, room, ts): each client's latest subscription.

    Rooms are numbers here, so that the maximum is a hash aggregate.
    """
    number = F.when(F.col("room") == ALL_ROOM, _ALL_NUMBER).otherwise(F.col("room").try_cast("long"))
    last = (subscriptions.select("client_id", "ts", number.alias("number"),
                                 packed(F.unix_micros("ts"), "id").alias("rank"))
            .groupBy("client_id").agg(F.max_by("number", "rank").alias("number"),
                                      F.max("ts").alias("ts")))
    room = F.when(F.col("number") == _ALL_NUMBER, ALL_ROOM).otherwise(F.col("number").cast("string"))
    return last.select("client_id", room.alias("room"), "ts")


def room_viewers(subscriptions: DataFrame) -> DataFrame:
    """(room, viewers) at the end of the feed."""
    return current_rooms(subscriptions).groupBy("room").agg(
        F.count(F.lit(1)).alias("viewers"))


def update_audience(subscriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """How many clients each update (id, auction_id, ts) reaches.

    ``room_clients`` get the full update, ``all_clients`` the price tick. Each
    subscription adds one to its room and takes one from the room it leaves, so
    an audience is a running sum per room; no update is paired with clients.
    Of things at the same instant, subscriptions come first.
    """
    # Parsed messages are stored once; both counts of hot keys and the history read them.
    shared_dir(subscriptions.sparkSession)
    subscriptions = subscriptions.select(
        "id", "client_id", "room", F.unix_millis("ts").alias("t")).checkpoint()
    hist = running(
        history(subscriptions, ["client_id"], ["t", "id"]),
        {"last": ("max", F.struct("t", "id", "room"))})
    # Subscribing again to the same room changes nothing.
    moves = hist.df.where(~F.col("room").eqNullSafe(F.col("last.room")))
    steps = moves.select("id", "t", F.lit(0).alias("kind"), F.inline(F.array(
        F.struct(F.col("room").alias("room"), F.lit(1).alias("step")),
        F.struct(F.col("last.room").alias("room"), F.lit(-1).alias("step"))))).where(
        F.col("room").isNotNull())

    asked = updates.select(
        F.col("id"), F.unix_millis("ts").alias("t"),
        F.explode(F.array(F.col("auction_id").cast("string"), F.lit(ALL_ROOM))).alias("room"))
    marks = asked.select("room", "t", F.lit(1).alias("kind"), "id", F.lit(0).alias("step"))
    # Each room is left at most as often as it is entered.
    entered = subscriptions.select("room")
    heard = entered.union(entered).union(asked.select("room"))
    counted = running(history(steps.unionByName(marks), ["room"], ["t", "kind", "id"], heard),
                      {"clients": ("sum", F.col("step"))}).df.where("kind = 1")
    in_all = F.col("room") == ALL_ROOM
    reached = counted.groupBy("id").agg(
        F.sum(F.when(~in_all, F.col("clients"))).cast("long").alias("room_clients"),
        F.sum(F.when(in_all, F.col("clients"))).cast("long").alias("all_clients"))
    return updates.select("id", "auction_id", "ts").join(reached, "id")


def viewer_sessions(signals: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """(client_id, session_start, session_end, signals): a client silent for more
    than ``gap_ms`` is gone and starts a new session when it returns."""
    hist = history(signals.select("id", "client_id", F.unix_millis("ts").alias("t")),
                   ["client_id"], ["t", "id"])
    hist = running(hist, {"previous": ("max", F.col("t"))})
    starts = F.col("previous").isNull() | (F.col("t") - F.col("previous") > gap_ms)
    hist = running(hist, {"session": ("sum", starts.cast("long"))}, inclusive=True)
    return (hist.df.groupBy("client_id", "session")
            .agg(F.min("t").alias("_from"), F.max("t").alias("_to"),
                 F.count(F.lit(1)).alias("signals"))
            .select("client_id", F.timestamp_millis("_from").alias("session_start"),
                    F.timestamp_millis(F.col("_to")).alias("session_end"), "signals"))
