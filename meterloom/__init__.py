"""Inference telemetry and measurement analytics on Spark DataFrames."""
