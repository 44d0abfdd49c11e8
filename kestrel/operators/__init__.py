"""DataFrame -> DataFrame operators (profiling, cleaning, features, time series, metrics)."""
