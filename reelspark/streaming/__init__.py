"""Keyed state for synchronised, bounded buffers."""
