"""quarry: audit, text and event analytics expressed as Spark DataFrames."""
