"""Operators for preparing training data: sampling, packing, splitting, chunking, overlap, mixing, screening."""
