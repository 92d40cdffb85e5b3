"""Relational plans: evaluation, catalogue, splits, routing, recovery, configuration."""
