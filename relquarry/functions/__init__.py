"""Scalar functions: text analysis, geography, vectors, highlighting."""
