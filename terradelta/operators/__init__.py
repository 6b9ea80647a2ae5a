"""Joins, rules, reports, samples and rankings on DataFrames."""
