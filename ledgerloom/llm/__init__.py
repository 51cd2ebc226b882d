"""Operators for preparing training data: media, tokens, near duplicates, mixing, packing.

Nothing else in the library imports this subpackage; ``queries`` registers its queries.
"""
