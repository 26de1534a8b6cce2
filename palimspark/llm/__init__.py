"""Operators for large training-data corpora.

Everything here stands alone: no other module of the library imports this subpackage.
"""
