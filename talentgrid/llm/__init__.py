"""Operators for large text corpora: duplicates, tokens, secrets, neighbours, leaks and languages."""
