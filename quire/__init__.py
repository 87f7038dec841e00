"""Spark library for book corpora: structure, retrieval, grounding, quality, practice."""
