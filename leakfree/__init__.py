"""Leak-free analytics on Spark DataFrames for time-ordered entity data."""
