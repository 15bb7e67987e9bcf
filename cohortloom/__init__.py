"""Spark-native operators for episode reconstruction and matched-cohort analysis."""
