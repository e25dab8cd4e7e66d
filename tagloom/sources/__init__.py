"""Readers and writers: CoNLL, JSON lines, result files, parquet tables."""
