"""Memory retrieval and training-data preparation as lazy Spark plans."""

__version__ = "0.1.0"
