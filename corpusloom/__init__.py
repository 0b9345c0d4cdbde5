"""corpusloom: text-corpus analytics and preparation on Spark DataFrames."""
