"""Lectern: analytics over a research library and its text corpora, built on Spark DataFrames."""
