"""Relational operators over registers, spans and ledgers: DataFrames in, DataFrames out."""
