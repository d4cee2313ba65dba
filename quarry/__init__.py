"""quarry: a relational analytics engine expressed in PySpark DataFrames and SQL."""
