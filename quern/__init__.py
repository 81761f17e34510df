"""quern: a PySpark-native engine for retrieval, data quality and usage analytics over note collections."""
