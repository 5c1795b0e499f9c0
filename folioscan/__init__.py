"""Folioscan: boolean document search and text processing on Spark DataFrames."""
