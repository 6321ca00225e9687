"""Spark-native analytics over cited, time-dependent rules and the text they come from."""
