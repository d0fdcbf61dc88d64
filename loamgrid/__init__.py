"""loamgrid: a Spark-first engine for tables, layers, rasters and series.

Every operator takes and returns lazy DataFrames; see README.md.
"""
