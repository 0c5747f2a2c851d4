"""A PySpark-native code-fact analytics engine."""
