"""Operators for training-data pipelines: language, quality, duplicates, privacy, mixing, tokens.

Nothing else in the library imports this subpackage.
"""
