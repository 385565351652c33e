"""Operators for large text corpora used in training: archives, duplicates, secrets, mixing, packing, quality."""
