"""Operators for large corpora of training texts."""
