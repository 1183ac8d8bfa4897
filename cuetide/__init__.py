"""Timed-text and media-event analytics on Spark DataFrames."""
