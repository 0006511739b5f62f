"""sonarloom: Spark-native manifest, sequence and signal analytics."""
