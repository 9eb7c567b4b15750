"""tabwright: take a table from raw file to scored predictions with Spark.

Every operator is a function from DataFrames to a DataFrame.  Fitted state is
always a bounded set of numbers taken from aggregates; applying it is a
row-local projection.
"""

__version__ = "0.1.0"
