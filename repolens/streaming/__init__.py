"""Structured Streaming versions of the growing-feed reports."""
