"""siftwork: document-intelligence operators written as Spark DataFrame code."""

__version__ = "0.1.0"
