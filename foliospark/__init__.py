"""foliospark: a document algebra (ordered pages, lines, blocks, cells) on Spark DataFrames."""
