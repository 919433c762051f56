"""Volumes from arrays, tables and generators; sinks."""
