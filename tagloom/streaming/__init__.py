"""Structured Streaming variants of the resumable log."""
