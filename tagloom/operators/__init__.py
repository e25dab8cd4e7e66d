"""Relational operators: spans, metrics, splits, records, resampling, selection, ranking."""
