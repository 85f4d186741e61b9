"""Scalar semantics that the operators share."""
