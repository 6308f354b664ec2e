"""Operators for training-data pipelines: filtering, deduplication, search, masking, mixing."""
