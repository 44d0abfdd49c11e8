"""Splits, cross-validation, MLlib-backed models, clustering and forecasting."""
