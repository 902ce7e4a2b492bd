"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Each query is run to completion without collecting its rows, after
the stored market that the views read has been written (timed on its own).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gavel.checks import catalog
from gavel.session import prepare

HEADLINE = [
    "market_snapshot", "replay_bids", "replay_bids_6h", "settle_transactions", "replay_checkout",
    "replay_login_throttle", "replay_login_throttle_3d", "update_audience", "room_viewers",
    "viewer_sessions", "winning_bid", "bid_history_topk", "bids_received_topk", "bids_by_user",
    "buyer_stats", "seller_stats", "dashboard_role_view", "open_auctions_feed", "auction_detail",
    "auction_page", "listings_by_seller", "wins_by_buyer", "validate_listings_rejected",
    "validate_registrations", "ingest_users", "ingest_listings_auctions", "seed_bid_ladder",
    "erase_cascade", "check_integrity", "stream_bids", "stream_throttle", "stream_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = prepare(SparkSession.builder.master(f"local[{cpus}]").appName("bench")
                    .config("spark.sql.shuffle.partitions", cpus)
                    .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
                    .config("spark.python.sql.dataFrameDebugging.enabled", "false")
                    .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
                    .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()

    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("write_market", lambda: catalog.market(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir)
              .write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total wall time of headline queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
