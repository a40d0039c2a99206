"""Rollups kept fresh from a stream."""
