"""Auction analytics on Spark: replay, settlement, views, checks and live streams."""
