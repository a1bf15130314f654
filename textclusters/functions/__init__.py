"""Column functions that follow the rules of line-based annotation."""
