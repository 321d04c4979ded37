"""A Spark-native analytics engine for captured mail traffic."""
