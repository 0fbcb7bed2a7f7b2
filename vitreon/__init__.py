"""Spark-first analytics for glass structures, simulation series, job tables and training text."""
