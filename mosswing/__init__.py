"""A PySpark-native engine for hybrid retrieval with final deletions, and for training-data pipelines."""
