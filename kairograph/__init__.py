"""Temporal property-graph dependency mining on Spark DataFrames."""
