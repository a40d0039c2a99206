"""Resolved queries as DataFrames."""
