"""Operators that prepare large text, page and vector collections for training."""
