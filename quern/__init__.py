"""A Spark-native analytics engine with self-tuning selectivity estimation."""
