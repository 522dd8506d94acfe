"""Walk-forward evaluation analytics on PySpark DataFrames."""
