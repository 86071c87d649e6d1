"""Joins, aggregations and other table operators."""
