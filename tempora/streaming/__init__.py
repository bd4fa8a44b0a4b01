"""Structured Streaming forms of the continuous analytics."""
