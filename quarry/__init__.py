"""quarry: a Spark-native analytics engine for source-code snapshots."""
