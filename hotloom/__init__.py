"""Spark-first analytics over point reports: cleaning, places, hotspots and series."""

__version__ = "0.1.0"
