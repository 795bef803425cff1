"""Flowquarry: a PySpark-native analytics engine for network-traffic metadata."""
