"""Incremental use of the operators."""
