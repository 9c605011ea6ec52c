"""Operational-telemetry analytics on Spark DataFrames."""
