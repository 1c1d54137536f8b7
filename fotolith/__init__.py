"""Queries and processing of photo libraries as data, on Spark."""
