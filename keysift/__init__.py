"""Distributed credential-leak analytics over DataFrames of text."""
