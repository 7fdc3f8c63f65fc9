"""A PySpark-native engine for document, retrieval and training-data corpora."""
