"""lexiloom: a PySpark-native engine for compressed, immutable string dictionaries."""
