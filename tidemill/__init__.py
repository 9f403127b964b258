"""Spark-native rolling features of transaction events, in batch and as a stream."""
