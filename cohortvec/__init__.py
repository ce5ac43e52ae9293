"""Event-history embedding and similarity ranking on Spark.

Everything takes and returns DataFrames.  See README.md for the map from task
to function.
"""

__version__ = "0.1.0"
