"""A Spark-native deductive analytics engine."""
