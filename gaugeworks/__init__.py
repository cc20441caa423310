"""PySpark-native analytics for visual-inspection data sets."""
