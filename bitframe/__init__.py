"""A PySpark-native engine for bit-precise expression analysis, record analytics and training-data preparation."""
