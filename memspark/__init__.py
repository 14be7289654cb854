"""memspark: project-knowledge analytics on Spark DataFrames."""
