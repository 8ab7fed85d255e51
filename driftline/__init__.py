"""Spark-native transport, repair and reconciliation of one-way event streams."""
