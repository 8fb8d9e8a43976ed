"""Streaming of stored results to a client in column-major chunks."""
