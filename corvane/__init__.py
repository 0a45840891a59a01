"""corvane: retrieval, text metrics, evaluation summaries, data quality, signal arrays and session logic on Spark DataFrames."""
