"""sutur - a PySpark-native engine for text-line corpora and their page geometry."""

__version__ = "0.1.0"
