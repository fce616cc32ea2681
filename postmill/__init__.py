"""A Spark-native engine that turns captured board pages into clean posting tables."""
