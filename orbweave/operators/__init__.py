"""Relational and data-processing operators: DataFrame(s) in, DataFrame out."""
