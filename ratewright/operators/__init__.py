"""Operators. Every function takes and returns DataFrames; the caller owns the session."""
