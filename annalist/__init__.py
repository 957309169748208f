"""Bitemporal analytics over versioned public records, on PySpark DataFrames."""
