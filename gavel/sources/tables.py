"""Typed scans and snapshot writes of the five stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from gavel.schemas import TABLES


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    items: DataFrame
    auctions: DataFrame
    bids: DataFrame
    transactions: DataFrame

    def items_by_name(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def scan_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[table]).format(fmt).load(f"{path}/{table}")


def scan_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """Read the tables below ``path`` with their declared schema, nothing inferred.

    Columns the schema does not name, such as a password hash, are never read.
    """
    return Tables(**{name: scan_table(spark, path, name, fmt) for name in TABLES})


# Row order within the stored tables, by which lookups and the due scan skip row
# groups. Each ends in a unique column, so a hot seller or auction is split too.
LAYOUT = {"users": ("id",), "items": ("seller_id", "id"), "auctions": ("status", "end_time", "id"),
          "bids": ("auction_id", "id"), "transactions": ("auction_id", "id")}

# Columns that keyed views look up and that the layout doesn't serve: Parquet keeps bloom
# filters on them.
LOOKUPS = {"users": ("email",), "items": ("id",), "auctions": ("id", "item_id", "winner_id"),
           "bids": ("bidder_id",), "transactions": ("buyer_id", "seller_id")}


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[df[f.name].cast(f.dataType) for f in TABLES[table]])


def _writer(df: DataFrame, table: str, fmt: str) -> DataFrameWriter:
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKUPS[table]}
    return df.write.format(fmt).options(**blooms if fmt == "parquet" else {})


def write_tables(tables: Tables, path: str, fmt: str = "parquet") -> str:
    """Write a complete snapshot to a new folder, each table in its layout.

    Files of several tables cannot be replaced in one step, so a snapshot never
    overwrites another one: readers get the new path once all tables are there.
    """
    for name, df in tables.items_by_name().items():
        laid_out = _typed(df, name).repartitionByRange(*LAYOUT[name]).sortWithinPartitions(
            *LAYOUT[name])
        _writer(laid_out, name, fmt).mode("errorifexists").save(f"{path}/{name}")
    return path


def append_rows(df: DataFrame, path: str, table: str, fmt: str = "parquet") -> None:
    """Append checked rows to one stored table."""
    _writer(_typed(df, table), table, fmt).mode("append").save(f"{path}/{table}")
