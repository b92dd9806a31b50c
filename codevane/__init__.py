"""codevane: vector-quantised sparse retrieval and corpus preparation on Spark DataFrames."""
