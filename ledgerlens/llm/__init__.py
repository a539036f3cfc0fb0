"""Operators that prepare text corpora, vectors and conversations for training."""
