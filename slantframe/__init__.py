"""slantframe: synthetic aperture radar analytics on Spark DataFrames."""
