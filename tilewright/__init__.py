"""Spark jobs for the data side of microscopy image segmentation."""

__version__ = "0.1.0"
