"""Operators: every function takes and returns DataFrames or small result tables."""
