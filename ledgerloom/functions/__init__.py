"""Scalar functions as columns, and span extractors as table functions."""
