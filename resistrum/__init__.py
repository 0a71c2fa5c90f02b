"""Antimicrobial-resistance surveillance analytics on Spark DataFrames."""
