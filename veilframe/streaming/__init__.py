"""Masks on streaming DataFrames."""
