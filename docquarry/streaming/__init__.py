"""Stateless question streams against static index tables."""
