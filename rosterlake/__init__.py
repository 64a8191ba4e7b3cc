"""rosterlake: piles of business files to clean records to form cells, on Spark.

Every public name is a function from DataFrames (or Columns) to DataFrames (or
Columns). Nothing here creates a session, and nothing is collected.
"""
