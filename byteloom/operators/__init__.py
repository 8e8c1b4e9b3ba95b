"""Operators over DataFrames of byte content."""
