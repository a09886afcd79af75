"""Reviewers of a backtest, the council that merges them, diagnosis and self-check."""
