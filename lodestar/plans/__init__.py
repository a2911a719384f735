"""Relational views and SQL."""
