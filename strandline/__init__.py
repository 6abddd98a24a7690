"""Records analytics on Spark: parameterised DataFrame operators."""
