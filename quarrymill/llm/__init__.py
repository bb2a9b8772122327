"""Operators of a training-data pipeline; ``registry`` has their queries and SQL."""
