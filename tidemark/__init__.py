"""A Spark-native engine for versioned key-value changelogs."""

__version__ = "0.1.0"
