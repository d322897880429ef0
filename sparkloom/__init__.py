"""Spark-first engine for language-model training data and experiment evidence."""
