"""Joins, aggregations, windows and rankings over documents, chunks, candidates and logs."""
