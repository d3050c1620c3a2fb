"""coffer: Spark-native backup catalogue and content engine."""
