"""kestrel — tabular and time-series analytics and ML operators on Spark.

Every operator takes and returns Spark DataFrames and is expressed with the
DataFrame / SQL / MLlib APIs so that Catalyst plans it and the cluster runs it.
"""

__version__ = "0.1.0"
