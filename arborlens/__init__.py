"""arborlens: a PySpark-native analytics engine for the structure of software."""

__version__ = "0.1.0"
