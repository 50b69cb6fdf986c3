"""Spark-native profiling and first exploratory analysis of any table."""
