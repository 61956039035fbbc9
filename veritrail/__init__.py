"""Evidence analytics over bi-temporal facts, written for Spark DataFrames."""
