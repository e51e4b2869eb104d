"""A Spark-native engine for tracked-object timelines and machine-reported interactions."""
