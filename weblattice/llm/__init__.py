"""Operators that a large-scale training-data pipeline needs, beside the crawl-frontier operators."""
