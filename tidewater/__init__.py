"""Tidewater: temporal transaction-graph analytics on Spark DataFrames."""
