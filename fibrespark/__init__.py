"""fibrespark: oriented points from microscopy images, and training-data operators, as Spark DataFrames."""
