"""lumenframe: Spark-native analytics for labelled tables, layered graphs and small layered models."""

__version__ = "0.1.0"
