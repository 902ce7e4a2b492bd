"""JSON documents of the views, and repeat-safe batches of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(df: DataFrame, name: str = "document") -> DataFrame:
    """One JSON text per row, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json_feed(df: DataFrame, path: str) -> None:
    json_documents(df).write.mode("errorifexists").text(path)


def write_listing_batch(items: DataFrame, auctions: DataFrame, path: str, batch_id: int) -> None:
    """Both halves of the listings of one micro-batch, or nothing of them.

    Each batch has a folder of its own in both tables, which a second run replaces. The
    batch counts once its mark is there, and that is written last.
    """
    for name, rows in (("items", items), ("auctions", auctions)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    mark = items.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{batch_id}")


def read_listing_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, auctions) of the complete batches."""
    marks = spark.read.parquet(f"{path}/marks/*")

    def complete(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{name}")
        return rows.join(marks, rows["batch_id"] == marks["batch_id"], "left_semi").drop("batch_id")

    return complete("items"), complete("auctions")
