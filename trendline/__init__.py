"""Trend and data-repair jobs written as plain DataFrame-to-DataFrame functions."""
