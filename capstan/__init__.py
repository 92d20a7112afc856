"""Capstan: a Spark-native engine for reproducible, verifiable data analysis."""
