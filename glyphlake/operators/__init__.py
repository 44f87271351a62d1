"""Joins, aggregates, ordered scans, ranks and set operations over tables."""
