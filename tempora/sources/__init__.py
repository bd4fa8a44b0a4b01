"""Inputs: Parquet tables and the change log."""
