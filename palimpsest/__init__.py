"""A versioned record ledger, hybrid retrieval and evaluation analytics as Spark DataFrames."""
