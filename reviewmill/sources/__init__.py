"""Readers, writers and the review views over the given tables."""
