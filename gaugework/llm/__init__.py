"""Operators of a training-data pipeline: dedup, mixing, classifiers, archives, search, tokens.

Nothing else in the library imports this folder.
"""
