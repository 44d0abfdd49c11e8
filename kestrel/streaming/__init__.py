"""Structured Streaming forms of the resampling operators.

The reference has no stream input; the same bin aggregation is offered for
streaming DataFrames so that a growing table can be resampled incrementally.
"""
