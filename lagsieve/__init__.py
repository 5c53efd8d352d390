"""A Spark-native engine that decides which channels of a panel help to predict which others."""
