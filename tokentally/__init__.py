"""Token-usage analytics on Spark: logs in, priced and aggregated reports out."""
