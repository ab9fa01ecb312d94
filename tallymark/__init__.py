"""Spark-native evidence analytics: DataFrame-to-DataFrame operators over runs, samples, items and audits."""
