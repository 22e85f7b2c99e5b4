"""Quillmark: prediction-evaluation analytics as declarative Spark plans."""

__version__ = "0.1.0"
