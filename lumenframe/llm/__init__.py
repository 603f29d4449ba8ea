"""Training-data operators: deduplication, packing, tokenising, scoring and media columns on Spark."""
