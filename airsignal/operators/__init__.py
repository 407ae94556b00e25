"""DataFrame operators: per-series windows, feature blocks, insights."""
