"""Scalar functions of the query language and the block checksum."""
