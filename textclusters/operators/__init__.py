"""Operators from DataFrame to DataFrame; none keeps state."""
