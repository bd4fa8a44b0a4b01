"""Relational, temporal and analytical operators as DataFrame transformations."""
