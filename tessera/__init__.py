"""tessera: a PySpark-native engine for catalogues, keyed indexes, ranking and incremental work."""
