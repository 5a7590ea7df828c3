"""Labelled-text analytics on Spark: cleaning, deduplication, splits, features, profiles, evaluation."""
