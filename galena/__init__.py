"""Rubric-evaluation analytics on DataFrames."""
