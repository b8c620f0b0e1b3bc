"""Readers of the raw files and the trusted tables."""
