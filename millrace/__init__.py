"""A PySpark-native engine for feature pipelines, predictive models and their metrics."""
