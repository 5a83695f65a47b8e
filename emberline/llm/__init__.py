"""Operators of a training-data pipeline, each with its query; nothing else in the library imports this package."""
