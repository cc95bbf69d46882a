"""Data quality for large tables on Spark: profile, detect, show evidence, repair, decide."""
