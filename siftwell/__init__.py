"""siftwell: document curation and analytics over Spark DataFrames."""
