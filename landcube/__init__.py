"""PySpark-native analytics for satellite land-cover tables."""
