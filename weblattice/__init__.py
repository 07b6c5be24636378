"""Spark-native analytics over crawl-frontier data."""
