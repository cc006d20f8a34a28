"""Spark-native analytics over application logs, code graphs and test evidence."""
