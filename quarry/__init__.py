"""quarry: Spark-native retrieval, duplicate analysis and corpus preparation."""
