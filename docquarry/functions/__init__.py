"""Column-level text, vector and scoring functions."""
