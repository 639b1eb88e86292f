"""A Spark-native analytics engine for corpora of generated programs, documents and model interactions."""
