"""Operators for training-data pipelines over large text tables.

Nothing else in the library imports this subpackage. Every operator reads whole
texts, treats a null text as empty, and keeps to Spark for partitioning and
shuffles; Python works on Arrow batches inside tasks only.
"""
