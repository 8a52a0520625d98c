"""Trade-surveillance analytics on PySpark DataFrames."""
