"""Operators on whole DataFrames: corpus hygiene, cleaning, quality, records, windows, scoring, statistics."""
