"""A PySpark-native engine for Windows event logs and the tables made from them."""

__version__ = "0.1.0"
