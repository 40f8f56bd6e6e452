"""Set-oriented retrieval and data-processing engine on PySpark DataFrames."""
