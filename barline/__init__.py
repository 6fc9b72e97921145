"""Time-series analytics on Spark: bars, rolling features, as-of joins, statistics, signals."""
