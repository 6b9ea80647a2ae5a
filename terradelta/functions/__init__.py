"""Scalar functions on geometry."""
