"""tapeworks: market-data research on PySpark DataFrames."""
