"""lodestream: a PySpark-native engine for time-ordered telemetry and text corpora."""
