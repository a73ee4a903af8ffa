"""Spark-native exact similarity search, versioned tables and replay."""
