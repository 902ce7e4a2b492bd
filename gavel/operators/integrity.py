"""Constraint checks over the stored tables.

Every check yields (rule, table_name, row_key, detail) rows for violations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import schemas
from gavel.sources.tables import Tables

FOREIGN_KEYS = (
    ("items", "seller_id", "users"),
    ("auctions", "item_id", "items"),
    ("auctions", "winner_id", "users"),
    ("bids", "auction_id", "auctions"),
    ("bids", "bidder_id", "users"),
    ("transactions", "auction_id", "auctions"),
    ("transactions", "buyer_id", "users"),
    ("transactions", "seller_id", "users"),
)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _row_rules(table: str, df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Violations of per-row rules (name, violated, detail) in one scan.

    A null result means the rule is not violated, as for a declared CHECK.
    """
    found = F.array_compact(F.array(*[
        F.when(violated, F.struct(F.lit(name).alias("rule"),
                                  detail.cast("string").alias("detail")))
        for name, violated, detail in rules]))
    return df.select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("row_key"),
                     F.explode(found).alias("v")).select(
        "v.rule", "table_name", "row_key", "v.detail")


Rule = tuple[str, Column, Column]


def _domain(column: str, allowed: tuple[str, ...]) -> Rule:
    return f"domain:{column}", ~F.col(column).isin(*allowed), F.col(column)


def _at_least(column: str, least: int) -> Rule:
    return f"range:{column}", F.col(column) < least, F.col(column)


def _domain_rules() -> dict[str, list[Rule]]:
    return {"users": [_domain("role", schemas.ROLES)],
            "auctions": [_domain("status", schemas.AUCTION_STATUSES)],
            "transactions": [_domain("status", schemas.PAYMENT_STATUSES)]}


def _range_rules() -> dict[str, list[Rule]]:
    order = ("range:end_time", F.col("end_time") <= F.col("start_time"),
             F.unix_millis("end_time") - F.unix_millis("start_time"))
    return {"auctions": [_at_least("starting_price", 0), _at_least("current_price", 0), order],
            "bids": [_at_least("amount", 1)], "transactions": [_at_least("amount", 1)]}


def _not_null_rules() -> dict[str, list[Rule]]:
    return {name: [(f"not_null:{f.name}", F.col(f.name).isNull(), F.lit(None))
                   for f in schema if not f.nullable]
            for name, schema in schemas.TABLES.items()}


def _check_rows(t: Tables, *rules: dict[str, list[Rule]]) -> DataFrame:
    """All given rules, with one scan of each table they concern."""
    combined = {name: [rule for group in rules for rule in group.get(name, [])]
                for name in schemas.TABLES}
    return _union([_row_rules(name, df, combined[name])
                   for name, df in t.items_by_name().items() if combined[name]])


def check_domains(t: Tables) -> DataFrame:
    """Enumerated columns outside their value set."""
    return _check_rows(t, _domain_rules())


def check_ranges(t: Tables) -> DataFrame:
    """Negative prices, amounts that are not positive, ends before starts."""
    return _check_rows(t, _range_rules())


def check_not_null(t: Tables) -> DataFrame:
    """Nulls in columns declared NOT NULL."""
    return _check_rows(t, _not_null_rules())


def check_unique(t: Tables) -> DataFrame:
    """Ids, case-insensitive emails and one invoice per auction."""
    keys = [(name, "id", F.col("id")) for name in schemas.TABLES]
    keys += [("users", "email", F.lower("email")), ("transactions", "auction_id",
                                                    F.col("auction_id"))]
    tables = t.items_by_name()
    return _union([
        tables[name].groupBy(value.cast("string").alias("row_key"))
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND row_key IS NOT NULL")
        .select(F.lit(f"unique:{column}").alias("rule"), F.lit(name).alias("table_name"),
                "row_key", F.col("n").cast("string").alias("detail"))
        for name, column, value in keys])


def check_foreign_keys(t: Tables) -> DataFrame:
    """References to missing rows, one line per missing value with its row count.

    References are counted first, so a value used by very many rows meets the
    join as one row.
    """
    tables = t.items_by_name()

    def missing(child: str, column: str, parent: str) -> DataFrame:
        used = (tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("ref"))
                .agg(F.count(F.lit(1)).alias("n")))
        known = tables[parent].select(F.col("id").alias("ref"))
        return used.join(known, "ref", "left_anti").select(
            F.lit(f"foreign_key:{column}").alias("rule"), F.lit(child).alias("table_name"),
            F.col("ref").cast("string").alias("row_key"), F.col("n").cast("string").alias("detail"))

    return _union([missing(*fk) for fk in FOREIGN_KEYS])


def _top_bids(t: Tables) -> DataFrame:
    """(auction_id, top_bid, current_price) of auctions with bids."""
    top = t.bids.groupBy("auction_id").agg(F.max("amount").alias("top_bid"))
    prices = t.auctions.select(F.col("id").alias("auction_id"), "current_price")
    return top.join(prices, "auction_id", "left")


def price_mismatches(t: Tables) -> DataFrame:
    """Auctions with bids whose highest bid is not the current price."""
    return _top_bids(t).where(F.col("top_bid") != F.col("current_price"))


def price_invariant(t: Tables) -> DataFrame:
    """One row: auctions with bids, and those that break the price rule."""
    return _top_bids(t).agg(
        F.count(F.lit(1)).alias("auctions_with_bids"),
        F.count_if(F.col("top_bid") != F.col("current_price")).alias("violations"))


def check_integrity(t: Tables) -> DataFrame:
    """All declared constraints and the price rule."""
    price = price_mismatches(t).select(
        F.lit("invariant:current_price").alias("rule"), F.lit("auctions").alias("table_name"),
        F.col("auction_id").cast("string").alias("row_key"),
        F.col("top_bid").cast("string").alias("detail"))
    rows = _check_rows(t, _domain_rules(), _range_rules(), _not_null_rules())
    return _union([rows, check_unique(t), check_foreign_keys(t), price])
