"""Curation analytics for training corpora on Spark."""
