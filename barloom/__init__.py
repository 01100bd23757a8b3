"""barloom: market-bar analytics written as small DataFrame -> DataFrame functions on Spark."""
