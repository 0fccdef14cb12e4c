"""Suspectra: finds the input values that have an unusual impact on computed results, on Spark."""
