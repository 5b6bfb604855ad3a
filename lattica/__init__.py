"""lattica: labelled-geometry analytics on Spark DataFrames."""
