"""Multi-block analytics on PySpark DataFrames."""
