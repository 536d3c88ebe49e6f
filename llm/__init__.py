"""Operators of a training-data pipeline; nothing else in the repository imports this package."""
