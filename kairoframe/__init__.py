"""kairoframe: temporal analytics over ordered entity samples, as lazily built Spark DataFrames."""
