"""Relational operators: chunking, indexing, search, fusion, routing, answering, evaluation and validation."""
