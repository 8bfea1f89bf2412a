"""Tracewell: Spark-native analytics for the traces and outputs of AI agents."""
