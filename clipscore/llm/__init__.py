"""Operators for training-data pipelines over text and vectors; nothing else in the library imports them."""
