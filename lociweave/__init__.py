"""Spark-native contig ordering, splitting and scaffolding."""
