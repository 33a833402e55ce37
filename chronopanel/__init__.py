"""Panel analytics and point-in-time forecast evaluation on Spark DataFrames."""
