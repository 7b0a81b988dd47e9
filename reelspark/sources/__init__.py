"""Readers and writers of framed binary formats."""
