"""Demand tables kept up to date from streams."""
