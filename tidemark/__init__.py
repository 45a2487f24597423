"""Metric algebra over time buckets, as lazy Spark DataFrames."""
