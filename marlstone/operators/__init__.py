"""Operators of the query language: selection, statistics and checksums."""
