"""gridweave: raster, vector and time-series analytics as Spark DataFrame plans."""
