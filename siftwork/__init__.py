"""siftwork: profiling, template mining and record parsing on Spark DataFrames."""
