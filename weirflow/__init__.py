"""A Spark-native engine for bounded and unbounded record pipelines."""
