"""Scalar expressions: colour, bytes, time, tags and transforms."""
