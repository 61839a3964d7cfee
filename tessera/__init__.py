"""Tessera: a PySpark-native analytics engine for channel, video and comment snapshots."""
