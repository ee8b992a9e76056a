"""Whole plans: the tournament pipeline, the routed backtest, and the registered queries."""
