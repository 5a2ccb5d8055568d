"""Spark-native analytics over file catalogues, timed event streams and text."""
