"""A PySpark-native engine for analysing scanned-document collections."""
