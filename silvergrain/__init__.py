"""A PySpark-native engine for annotated media archives."""
