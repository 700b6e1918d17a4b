"""Spark-native lineage and trajectory analytics."""
