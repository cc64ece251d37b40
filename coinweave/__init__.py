"""Ledger forensics on Spark DataFrames."""
