"""PySpark-native quality analytics for networks of geo-located sensors."""
