"""Operators for training-data pipelines: text, token and archive processing on Spark."""
