"""skeinwork: a Spark-native engine for ranked retrieval over document collections."""
