"""A Spark-native time-series analytics engine."""
