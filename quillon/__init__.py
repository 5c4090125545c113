"""Quillon: a Spark-native workbench for very large delimited tables."""
