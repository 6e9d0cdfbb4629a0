"""PySpark-native lakehouse library for property-listing snapshots and corpus preparation."""
