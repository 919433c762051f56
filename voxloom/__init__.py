"""Labelled volumes and skeleton graphs as partitioned tables."""
