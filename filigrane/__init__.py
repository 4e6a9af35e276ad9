"""filigrane: analytics over sampled networks and image corpora, on Spark DataFrames."""
