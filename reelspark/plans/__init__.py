"""Registered queries, their SQL, and staged plans."""
