"""siltflow: incremental collection, deduplication, merging and change-only publishing on Spark."""
