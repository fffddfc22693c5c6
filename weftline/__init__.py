"""Spark-native analytics: trip marts, rankings, profiles, features and streaming ingestion."""
