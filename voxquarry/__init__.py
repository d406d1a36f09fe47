"""Spark DataFrame operators for text-grounded volumetric annotation data."""

__version__ = "0.1.0"
