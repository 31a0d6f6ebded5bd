"""Prospect analytics and training-data operators as PySpark DataFrame transforms."""
