"""Relational and bitemporal operators: DataFrame in, DataFrame out."""
