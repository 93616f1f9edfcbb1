"""quern: a PySpark-native engine for document corpora, event streams and star-schema tables."""
