"""Spark-native analytics over news, relations and prices."""
