"""Quarrymill: listings, documents and tax jobs as Spark DataFrames."""
