"""Spark jobs that build language resources from text: word and pair counts,
word clusters, and tables from annotated corpora."""
