"""Spark-native cleaning and reshaping of business tables of unknown layout."""
