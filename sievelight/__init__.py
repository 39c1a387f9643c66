"""Evidence search over collections of web pages, as PySpark DataFrames."""
