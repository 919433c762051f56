"""Fixpoint loops and the query catalogue."""
