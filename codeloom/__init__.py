"""codeloom: a PySpark-native engine for code and text retrieval data."""
