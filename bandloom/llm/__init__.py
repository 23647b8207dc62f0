"""Operators for large training-data pipelines: DataFrame in, DataFrame out."""
