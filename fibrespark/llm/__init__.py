"""Training-data operators: each module is one operator over Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
