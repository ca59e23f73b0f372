"""askloom: question-answer retrieval, scoring and corpus operators on Spark DataFrames."""
