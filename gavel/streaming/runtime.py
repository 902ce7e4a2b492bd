"""Starting streams: session settings, sources, and sinks for finite runs."""

from __future__ import annotations

import uuid
from inspect import signature
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.session import shared_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MICRO_BATCH = 64 * 1024 * 1024


def prepare_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB and upload its changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                files_per_trigger: int | None = None, bytes_per_trigger: int = MICRO_BATCH
                ) -> DataFrame:
    """Parquet files as a stream, oldest first, in micro-batches of bounded size.

    The bound matters: all rows that one key brings in a micro-batch are ordered
    in one task. A long backlog is for the batch operators, whose state a stream
    then starts from.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)


def _home(spark: SparkSession, name: str) -> str:
    prepare_state_store(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_folder(stream: DataFrame, name: str) -> str:
    """Process everything available and return the folder the stream wrote to.

    Output and checkpoint go to a new place in the shared folder.
    """
    home = _home(stream.sparkSession, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
             .start(f"{home}/rows"))
    query.awaitTermination()
    return f"{home}/rows"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(run_to_folder(stream, name))


def run_batches(stream: DataFrame, name: str, build: Callable[[DataFrame], DataFrame],
                mode: str = "append") -> DataFrame:
    """Process everything available, writing ``build(batch)`` for each micro-batch.

    Returns the rows of all batches with their ``batch_id``. A batch that is run
    again replaces its own folder.
    """
    spark = stream.sparkSession
    home = _home(spark, name)
    takes_id = len(signature(build).parameters) == 2

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = build(batch, batch_id) if takes_id else build(batch)
        rows.write.mode("overwrite").parquet(f"{home}/rows/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{home}/rows").withColumn("batch_id", F.col("batch_id").cast("long"))


def run_so_far(stream: DataFrame, name: str,
               build: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """As ``run_batches`` with ``build(batch, heard)``, the latter all rows up to the batch."""
    spark = stream.sparkSession
    home = _home(spark, f"{name}-heard")

    def with_past(batch: DataFrame, batch_id: int) -> DataFrame:
        batch.write.mode("overwrite").parquet(f"{home}/batch_id={batch_id}")
        heard = spark.read.parquet(home).where(F.col("batch_id") <= batch_id).drop("batch_id")
        return build(batch, heard)

    return run_batches(stream, name, with_past)


def run_updates(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """Process everything available in update mode and return each key's last row."""
    values = [c for c in stream.columns if c not in keys]
    rows = run_batches(stream, name, lambda batch: batch, "update")
    return (rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *values)).alias("last"))
            .select(*keys, *[F.col(f"last.{c}") for c in values]))
