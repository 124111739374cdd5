"""Operators for training-data pipelines: each in a module of its own, bound to the given tables in ``queries``."""
