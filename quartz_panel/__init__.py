"""Point-in-time panel analytics on Spark: DataFrame in, DataFrame out."""
