"""Sparse linear algebra and training-data operators as Spark DataFrame plans."""
