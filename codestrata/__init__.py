"""Structural change analytics and training-data operators on Spark."""
