"""Volumes that arrive slab by slab."""
