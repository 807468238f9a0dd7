"""Operators for large text corpora: scoring, counting, searching, cleaning."""
