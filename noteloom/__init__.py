"""Knowledge-base analytics and hybrid retrieval on Spark DataFrames."""
