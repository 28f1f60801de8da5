"""Spark-native evidence analytics: money, identity, reconciliation, revenue, anomalies and review as DataFrame operators."""
