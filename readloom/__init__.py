"""PySpark-native analytics for long-read sequence data, and operators for training-data pipelines."""
