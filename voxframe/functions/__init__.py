"""Column functions: draws keyed by identity, statistics of arrays, scores."""
