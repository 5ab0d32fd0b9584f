"""Spark-native building, augmenting, analysing and scoring of text-correction data."""
