"""Operators over demand tables: DataFrame in, DataFrame out."""
