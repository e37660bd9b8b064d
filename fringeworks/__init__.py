"""Spark-native engine for cleaning and reducing radio-interferometer visibilities."""
