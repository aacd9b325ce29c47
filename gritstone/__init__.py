"""gritstone: a Spark-native analytics engine with measured query rewriting."""

__version__ = "0.1.0"
