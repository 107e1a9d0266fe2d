"""Last-mile delivery analytics on Spark: quality, medallion layers, marts,
features, delay models, live state and what-if questions as DataFrame operators."""

__version__ = "0.1.0"
