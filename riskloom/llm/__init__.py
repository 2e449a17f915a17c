"""Training-data operators: ten corpus operators written as Spark jobs.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
