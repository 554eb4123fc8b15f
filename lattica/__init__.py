"""lattica: a Spark-native structural index and corpus analytics engine."""
