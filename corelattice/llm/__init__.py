"""Operators for large training-data sets: problems 2 to 8."""
