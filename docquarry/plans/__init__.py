"""Compositions of operators into whole queries, and their SQL counterparts."""
