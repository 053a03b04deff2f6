"""Scalar expressions and metrics."""
