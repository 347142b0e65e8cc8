"""A PySpark-native engine for entity- and code-graph analytics."""
