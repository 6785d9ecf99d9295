"""A Spark-native SQL analytics library."""
