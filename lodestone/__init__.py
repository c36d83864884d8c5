"""A PySpark-native engine for document collections: ingest, search, memory and access as DataFrame operators."""
