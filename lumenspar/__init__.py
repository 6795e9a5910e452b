"""A Spark-native analytics engine for metrics, logs, traces and monitors."""
