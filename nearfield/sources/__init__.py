"""Versioned vector tables on Parquet."""
