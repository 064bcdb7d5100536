"""slotstream: a PySpark-native engine for out-of-order, slot-keyed event streams."""

__version__ = "0.1.0"
