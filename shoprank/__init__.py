"""shoprank: hybrid (text + image) product retrieval and prompt assembly on Spark."""

__version__ = "0.1.0"
