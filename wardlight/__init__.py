"""Point-and-district analytics on Spark."""
