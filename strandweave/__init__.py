"""Haplotype reconstruction and training-data operators on Spark DataFrames."""
