"""Transaction-history consistency analytics, declared as Spark DataFrames."""
