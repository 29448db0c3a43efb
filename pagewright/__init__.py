"""Page-text analytics on Spark: layout, image, correction and evaluation operators over DataFrames."""
