"""roleweave: affect and association analytics over parsed text, as Spark jobs.

Every operator is a function from DataFrame to DataFrame.  See README.md for
the map from the blueprint's operator ids to functions and proof queries.
"""
