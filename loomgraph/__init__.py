"""Graph walks, pair tables, force-directed embedding and their evaluation on Spark DataFrames."""
