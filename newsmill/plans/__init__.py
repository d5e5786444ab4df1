"""Whole flows, and the queries that apply every operator to the given tables."""
