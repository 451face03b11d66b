"""Build, filter, label and evaluate reading-difficulty corpora as Spark DataFrames."""
