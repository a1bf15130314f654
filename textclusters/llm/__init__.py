"""Operators that prepare a text corpus for training language models."""
