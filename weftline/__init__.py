"""weftline: a PySpark-native engine for code-reference graphs."""
