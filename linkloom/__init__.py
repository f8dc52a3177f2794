"""Record linkage and corpus operators on Spark DataFrames."""
