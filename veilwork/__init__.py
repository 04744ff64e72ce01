"""veilwork: transcript de-identification as relational work on Spark DataFrames."""
