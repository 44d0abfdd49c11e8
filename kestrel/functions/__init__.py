"""Column-level functions and reusable statistics (quantiles, labels, parsing)."""
