"""quizlake: question banks, exam results and their upkeep as Spark DataFrames."""
