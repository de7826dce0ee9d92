"""Training-data operators: packing, privacy, scoring, deduplication, decontamination and filtering.

Nothing else in the library imports this subpackage.
"""
