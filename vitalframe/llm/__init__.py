"""Operators for text corpora: token ids, source mixing and language labels."""
