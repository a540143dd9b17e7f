"""Order-line analytics and regression on PySpark DataFrames."""
