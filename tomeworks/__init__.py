"""Text retrieval, retrieval evaluation and data preparation on Spark DataFrames."""
