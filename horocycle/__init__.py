"""Spark-native analytics over hyperbolic (Poincaré-ball) embeddings."""

__version__ = "0.1.0"
