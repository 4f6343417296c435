"""Readers, writers and the test tables derived from the driver's Parquet files."""
