"""Operators on volumes and skeleton graphs."""
