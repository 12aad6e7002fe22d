"""Approximate indexes, hybrid ranking and recall measures."""
