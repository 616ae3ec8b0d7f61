"""Spark-native analytics for multi-producer property graphs and bitemporal fact logs."""
