"""Readers, writers, schemas and manifests."""
