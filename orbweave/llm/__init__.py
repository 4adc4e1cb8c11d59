"""Operators for text corpora and record linkage. Nothing outside this subpackage imports it."""
