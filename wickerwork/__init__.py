"""wickerwork: evidence curation, leakage-safe splits, screening and corpus preparation on Spark DataFrames."""
