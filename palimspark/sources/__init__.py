"""Readers, writers, schemas and the views of the test tables."""
