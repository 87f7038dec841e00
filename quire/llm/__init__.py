"""Operators for preparing text corpora and vectors for language-model training."""
