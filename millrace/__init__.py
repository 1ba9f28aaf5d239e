"""millrace: a PySpark-native engine for fact memory, task learning and folded text."""
