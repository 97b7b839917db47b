"""Listing intelligence on Spark: sources, functions, operators, streaming jobs and registered queries."""
