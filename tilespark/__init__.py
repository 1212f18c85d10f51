"""tilespark: tiled-array analytics and rate-distortion experiments on Spark DataFrames."""
