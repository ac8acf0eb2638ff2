"""prefmill: preference-data analytics on Spark."""
