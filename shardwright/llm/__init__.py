"""Training-data operators over Spark DataFrames.  Nothing else in the library imports this subpackage."""
